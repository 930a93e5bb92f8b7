"""DuckDB SQL for the review queries: the same rules stated with list functions."""

from __future__ import annotations

from tamiza.lexicons import emotion as em
from tamiza.lexicons import rules as ru
from tamiza.lexicons import sarcasm as sa
from tamiza.operators import encoding as en

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_EDGE = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def norm(x: str) -> str:
    return f"lower(strip_accents({x}))"


def said(x: str, phrases) -> str:
    return f"regexp_matches({x}, {q(f'(?:^|{_EDGE})(?:' + '|'.join(p.replace(' ', ' ') for p in phrases) + f')(?:$|{_EDGE})')})"


def said_ws(x: str, phrases) -> str:
    return f"regexp_matches({x}, {q(f'(?:^|{_EDGE})(?:' + '|'.join(p.replace(' ', WS + '+') for p in phrases) + f')(?:$|{_EDGE})')})"


def free(i: str) -> str:
    """Token i is not negated."""
    return f"len(list_filter(neg, lambda g: {i} - g BETWEEN 1 AND 3)) = 0"


def n_plain(words) -> str:
    return f"len(list_filter(range(1, len(t) + 1), lambda i: list_contains({lst(words)}, t[i]) AND {free('i')}))"


def at(phrase: str, i: str = "i") -> str:
    return " AND ".join(f"t[{i} + {k}] = {q(w)}" if k else f"t[{i}] = {q(w)}" for k, w in enumerate(phrase.split()))


def any_at(phrases, extra: str) -> str:
    return f"len(list_filter(range(1, len(t) + 1), lambda i: coalesce(({' OR '.join(f'({at(p)})' for p in phrases)}), false) AND {extra})) > 0"


_REPORTED = f"len(list_filter(range(greatest(i - 4, 1), i), lambda r: list_contains({lst(em.REPORTING)}, t[r]))) = 0"
_AFTER = "len(list_filter(neg, lambda g: g - i BETWEEN 1 AND 6)) = 0"
_STEM = "regexp_matches(t[i], '^(?:" + "|".join(em.CATASTROPHE_STEMS) + ")')"


def catastrophe(after: bool) -> str:
    more = f" AND {_AFTER}" if after else ""
    return f"(len(list_filter(range(1, len(t) + 1), lambda i: list_contains({lst(em.CATASTROPHES)}, t[i]) AND {free('i')} AND {_REPORTED})) > 0 OR len(list_filter(range(1, len(t) + 1), lambda i: {_STEM} AND {free('i')} AND {_REPORTED}{more})) > 0)"


_NEG = f"list_filter(range(1, len(t) + 1), lambda i: list_contains({lst(em.NEGATIONS)}, t[i]))"
_RATING = "try_cast(trunc(CASE WHEN isnan(rating_num) OR isinf(rating_num) THEN NULL ELSE rating_num END) AS integer)"
_CONTRAST = r"\b(?:" + "|".join(w.replace(" ", WS + "+") for w in em.CONTRASTS) + r")\b"
_STRONG_NO = [p for p in em.STRONG_NEGATIVE if "no" in p.split()]
_STRONG = [p for p in em.STRONG_NEGATIVE if "no" not in p.split()]

# X10. Adjectives near hardware: those within three tokens of some hardware term are taken one per term, left to right.
_ADJ = f"list_filter(range(1, len(t) + 1), lambda j: list_contains({lst(em.NEGATIVE_ADJECTIVES)}, t[j]) AND {free('j')} AND NOT list_contains({lst(em.NEGATIVE)}, t[j]))"
_HW = f"list_filter(range(1, len(t) + 1), lambda i: list_contains({lst(em.HARDWARE)}, t[i]))"
_TAKEN = "list_reduce(list_prepend([]::bigint[], list_transform(hw, lambda h: [h])), lambda acc, h: CASE WHEN len(list_filter(adj, lambda j: j - h[1] BETWEEN -3 AND 3 AND NOT list_contains(acc, j))) > 0 THEN list_append(acc, list_filter(adj, lambda j: j - h[1] BETWEEN -3 AND 3 AND NOT list_contains(acc, j))[1]) ELSE acc END)"

EMOTION = f"""
WITH a AS (SELECT row_number() OVER () AS rn, id_review, final_clean_text, rating_num, rating, base_emotion, {norm('final_clean_text')} AS norm, {_RATING} AS r FROM complete),
b AS (SELECT *, string_split_regex(norm, {q(_CONTRAST)}) AS parts FROM a),
c AS (SELECT *, {strip('parts[1]')} AS before, {strip('parts[-1]')} AS tail FROM b),
d AS (SELECT *, regexp_extract_all(coalesce(CASE WHEN len(parts) = 1 THEN norm WHEN len(parts) = 2 THEN CASE WHEN length(tail) >= length(before) THEN tail ELSE before END WHEN tail <> '' THEN tail WHEN before <> '' THEN before ELSE norm END, ''), '[a-z]+') AS t FROM c),
e AS (SELECT *, {_NEG} AS neg FROM d),
f AS (SELECT *, {_ADJ} AS adj, {_HW} AS hw FROM e),
g AS (SELECT *,
  {n_plain(em.POSITIVE)} AS pos,
  {n_plain(em.NEGATIVE)} + len({_TAKEN}) AS n,
  len(list_filter(t, lambda x: list_contains({lst(em.NEGATIVE)}, x))) - {n_plain(em.NEGATIVE)} AS turned,
  (len(list_filter({lst(_STRONG_NO)}, lambda p: contains(' ' || array_to_string(t, ' ') || ' ', ' ' || p || ' '))) > 0 OR {any_at(_STRONG, free('i'))} OR {any_at(em.NEGATABLE, free('i') + ' AND ' + _AFTER)}) AS strong,
  {catastrophe(True)} AS cat,
  list_has_any(t, {lst(em.SADNESS)}) AS sad, list_has_any(t, {lst(em.POSITIVE)}) AS word, len(parts) > 1 AS con,
  regexp_matches(norm, {q(em.POSITIVE_QUESTION.format(ws=WS))}) AS ask, regexp_matches(norm, {q(em.SURPRISE.format(ws=WS))}) AS cue FROM f),
h AS (SELECT *, pos + turned AS p FROM g),
emo AS (SELECT rn, id_review, final_clean_text, rating_num, rating, base_emotion, r, CASE
  WHEN norm IS NULL OR norm = '' OR {strip('norm')} IN ('nan', 'none', 'null') THEN ''
  WHEN r IN (4, 5) THEN CASE WHEN cat THEN 'Enojo' WHEN strong THEN 'Neutral' WHEN n >= 2 OR (n >= 1 AND con) THEN 'Neutral' WHEN p > 0 THEN 'Alegría' ELSE base_emotion END
  WHEN r IN (1, 2) THEN CASE WHEN cat THEN 'Enojo' WHEN strong OR n > 0 THEN CASE WHEN sad THEN 'Tristeza' ELSE 'Enojo' END WHEN base_emotion IN ('Enojo', 'Tristeza') THEN base_emotion ELSE 'Neutral' END
  WHEN r = 3 THEN CASE WHEN p > n THEN 'Alegría' WHEN strong OR n > p THEN 'Neutral' WHEN base_emotion IN ('Sorpresa', 'Miedo') THEN base_emotion ELSE 'Neutral' END
  WHEN base_emotion = 'Neutral' AND (cat OR (strong AND n > 0)) THEN 'Enojo'
  WHEN base_emotion = 'Neutral' AND p > 0 THEN 'Alegría'
  WHEN base_emotion IN ('Tristeza', 'Miedo') AND n > 0 THEN 'Enojo'
  WHEN base_emotion IN ('Tristeza', 'Miedo') AND p > 0 AND con THEN 'Alegría'
  WHEN base_emotion = 'Alegría' AND strong THEN 'Enojo'
  WHEN base_emotion = 'Alegría' AND n > p THEN 'Neutral'
  WHEN base_emotion = 'Sorpresa' AND (ask OR (NOT cue AND word)) THEN 'Alegría'
  WHEN base_emotion = 'Asco' AND strong THEN 'Enojo'
  ELSE base_emotion END AS emotion FROM h)
"""


def _first_plain(phrase: str) -> str:
    n = len(phrase.split())
    pos = f"list_filter(range(1, len(t) + 1), lambda i: coalesce({at(phrase)}, false))[1]"
    calm = " AND ".join(f"len(list_filter(neg, lambda g: {pos} + {k} - g BETWEEN 1 AND 3)) = 0" for k in range(n))
    return f"({pos} IS NOT NULL AND {calm})"


_CURSE = f"len(list_filter(range(1, len(t) + 1), lambda i: (list_contains({lst(em.PROFANITY)}, t[i]) OR starts_with(t[i], 'ching')) AND {free('i')})) > 0"
_LONG = "(CASE WHEN len(list_filter(range(1, length(final_clean_text) - 1), lambda i: final_clean_text[i] <> chr(10) AND final_clean_text[i] = final_clean_text[i + 1] AND final_clean_text[i] = final_clean_text[i + 2])) > 0 THEN 1 ELSE 0 END)"
_UPPER = f"regexp_matches(final_clean_text, '(?:^|{_EDGE})[A-Z]{{3,}}(?:$|{_EDGE})')::integer"
_MULTI = r"regexp_matches(final_clean_text, '!!|\?\?')::integer"

INTENSITY = (
    EMOTION
    + f""", i0 AS (SELECT rn, id_review, final_clean_text, rating_num, rating, emotion, {norm('final_clean_text')} AS norm, coalesce(r, try_cast(nullif(regexp_extract(rating, '([0-9]+)', 1), '') AS integer)) AS r FROM emo),
i1 AS (SELECT *, regexp_extract_all(coalesce(norm, ''), '[a-z]+') AS t FROM i0),
i2 AS (SELECT *, {_NEG} AS neg FROM i1),
i3 AS (SELECT *, {catastrophe(False)} OR {' OR '.join(_first_plain(p) for p in [*em.LEGAL, *em.FINANCIAL, *em.LOYALTY])} OR {_CURSE} AS o,
  {n_plain(em.INTENSIFIERS)} AS ni, {n_plain(em.ABSOLUTES)} + {n_plain(em.DETERMINERS)} AS nd, {_UPPER} AS up, {_MULTI} AS mu, {_LONG} AS lo,
  {said('norm', em.MITIGATORS)}::integer + {said('norm', em.DOUBTS)}::integer + (regexp_matches(norm, {q(_CONTRAST)}) AND {n_plain(em.INTENSITY_POSITIVE)} > 0)::integer AS less FROM i2),
i4 AS (SELECT *, ni + nd + up + mu + lo - less AS s, ni >= 2 AND ((up = 1 AND mu = 1) OR lo = 1) AS sat, NOT coalesce(regexp_matches(final_clean_text, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]'), false) AS blank FROM i3),
i5 AS (SELECT *, CASE WHEN o OR sat OR s >= 4 THEN 4 WHEN s < 0 THEN 1 WHEN s = 0 THEN 2 ELSE 3 END AS l0 FROM i4),
i6 AS (SELECT *, CASE WHEN r = 3 AND l0 = 4 AND NOT o THEN CASE WHEN s > 0 THEN 3 ELSE 2 END ELSE l0 END AS l1 FROM i5),
i7 AS (SELECT *, CASE WHEN r IN (4, 5) AND l1 = 1 THEN 2 ELSE l1 END AS l2 FROM i6),
i8 AS (SELECT *, CASE WHEN r = 1 AND l2 = 3 AND s < 2 THEN 2 ELSE l2 END AS l3 FROM i7),
i9 AS (SELECT *, CASE WHEN emotion = 'Enojo' AND l3 < 3 AND s > 0 THEN 3 WHEN emotion = 'Asco' AND l3 < 3 THEN 3 WHEN emotion = 'Sorpresa' AND l3 = 2 AND s > 0 THEN 3 ELSE l3 END AS l4 FROM i8),
lev AS (SELECT rn, id_review, final_clean_text, rating_num, rating, emotion, norm, r, CASE WHEN blank THEN 2 ELSE l4 END AS intensity, CASE WHEN blank THEN false ELSE o END AS override, CASE WHEN blank THEN false ELSE sat END AS saturated, CASE WHEN blank THEN 0 ELSE s END AS score FROM i9)
"""
)

_TX = "coalesce(final_clean_text, '')"
_KW = lambda words, phrases: f"(list_has_any(t, {lst(words)}) OR {' OR '.join(f'contains(n, {q(p)})' for p in phrases)})"
_STRICT = f"""
WITH a AS (SELECT id_review, rating_num, rating, final_clean_text, {norm(_TX)} AS n FROM corrected),
b AS (SELECT *, regexp_extract_all(n, '[a-z]+') AS t FROM a),
c AS (SELECT *, (regexp_matches(n, {q(f'(?:^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])/s(?:$|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])')}) OR {said_ws('n', sa.TAGS)}) AS tag, regexp_matches(n, {q('|'.join(sa.IRONY))}) AS irony,
  {said_ws('n', sa.STRICT_CUES)} AND len(list_filter(t, lambda x: list_contains({lst([w for w in sa.NEGATIVE if w not in sa.TECHNICAL])}, x))) > 0 AS cue,
  {_KW(sa.POSITIVE_STRICT, sa.POSITIVE_PHRASES)} AS good, {said_ws('n', sa.CONTRASTS)} AS con, regexp_matches(n, {q(chr(91) + chr(34) + chr(39) + '“”](?:' + '|'.join(sa.QUOTED) + ')[' + chr(34) + chr(39) + '“”]')}) AS quo FROM b),
s AS (SELECT *, 4 * tag::integer + 4 * irony::integer + 2 * cue::integer + (cue AND good)::integer + (cue AND con)::integer + (cue AND quo)::integer AS score,
  array_to_string(list_filter([CASE WHEN tag THEN 'tag' END, CASE WHEN irony THEN 'frase_sarcastica' END, CASE WHEN cue THEN 'cue' END, CASE WHEN cue AND good THEN 'positivo' END, CASE WHEN cue AND con THEN 'contraste' END, CASE WHEN cue AND quo THEN 'comillas_positivas' END], lambda x: x IS NOT NULL), '+') AS reason FROM c)
"""
_TRUE = f"coalesce(lower({strip('possible_sarcasm')}) IN ('true', '1', 'si', 'yes'), false)"
_FULL = lambda c: f"coalesce(regexp_matches({c}, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]'), false)"
_SAME = lambda a, b: f"count(*) FILTER ({_FULL(a)} AND {_FULL(b)} AND {a} = {b})"

_CUE = r"(?i)\b(?:" + "|".join(w.replace(" ", WS + "+") for w in sa.CUES) + r")\b|/s"
_TURN = r"(?i)\b(?:" + "|".join(w.replace(" ", WS + "+") for w in sa.CONTRASTS) + r")\b"


def _norm_a(x: str) -> str:
    b = rf"regexp_replace({strip(collapse(x))}, '{WS}+([.,;:!?])', '\1', 'g')"
    return f"(CASE WHEN ends_with({b}, '.') AND NOT ends_with({b}, '...') THEN ({b})[:-2] ELSE {b} END)"


def _judge(x: str, words, phrases) -> str:
    n = norm(x)
    return f"(list_has_any(regexp_extract_all({n}, '[a-z]+'), {lst(words)}) OR {' OR '.join(f'contains({n}, {q(p)})' for p in phrases)})"


_BADX, _GOODX = (lambda x: _judge(x, sa.NEGATIVE, sa.NEGATIVE_PHRASES)), (lambda x: _judge(x, sa.POSITIVE_LOOSE, sa.POSITIVE_PHRASES))
_SARCASM_CLEAN = f"""
WITH a AS (SELECT id_review, final_clean_text AS x, coalesce(final_clean_text, '') AS y, {_FULL('final_clean_text')} AS full_ FROM corrected),
b AS (SELECT *, {norm('y')} AS n FROM a),
c AS (SELECT *, CASE WHEN NOT full_ THEN '' ELSE array_to_string(list_filter([CASE WHEN regexp_matches(n, {q(_CUE)}) THEN 'cue' END, CASE WHEN {_GOODX('y')} AND {_BADX('y')} AND regexp_matches(n, {q(_TURN)}) THEN 'positivo_vs_negativo' END], lambda v: v IS NOT NULL), '+') END AS reason FROM b),
d AS (SELECT *, {_norm_a(f"regexp_replace(x, {q(_CUE)}, '', 'g')")} AS t FROM c),
e AS (SELECT *, regexp_matches(t, {q(_TURN)}) AS turned, trim(regexp_extract(t, {q('(?s)^(.*?)' + _TURN)}, 1), ' ,.;:-') AS bef, trim(regexp_extract(t, {q('(?s)^.*?' + _TURN + '(.*)$')}, 1), ' ,.;:-') AS aft FROM d),
f AS (SELECT *, CASE WHEN NOT turned OR aft = '' THEN 'cues_removed' WHEN {_BADX('aft')} AND ({_GOODX('bef')} OR NOT {_BADX('bef')}) THEN 'kept_after_contrast' WHEN {_BADX('bef')} AND {_GOODX('aft')} THEN 'kept_before_contrast' ELSE 'contrast_kept_full' END AS outcome FROM e)
SELECT id_review, reason AS sarcasm_reason, CASE WHEN reason <> '' THEN outcome END AS sarcasm_outcome,
CASE WHEN NOT full_ THEN x WHEN reason = '' THEN {_norm_a('x')} WHEN outcome = 'kept_after_contrast' THEN {_norm_a('aft')} WHEN outcome = 'kept_before_contrast' THEN {_norm_a('bef')} ELSE t END AS final_clean_text FROM f"""

_COLS = ("final_clean_text", "clean_text", "text_after_sarcasm")
_LATIN = "[A-Za-zÀ-ÿ]+"
_CELLS = "WITH cells AS (" + " UNION ALL ".join(f"SELECT regexp_extract_all(lower(coalesce({c}, '')), '{_LATIN}') AS t FROM corrected" for c in _COLS) + ")"
_WORDS = _CELLS + ", w AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM cells) GROUP BY token)"
_PAIRS = f", p AS (SELECT t1, t2, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS x FROM cells) AS z(x), LATERAL (SELECT x.a AS t1, x.b AS t2) GROUP BY ALL)"
_SPLIT_PAIRS = f", p2 AS (SELECT * FROM p WHERE NOT list_contains({lst(ru.SPLIT_STOPWORDS)}, t1) AND NOT list_contains({lst(ru.SPLIT_STOPWORDS)}, t2))"
_SPANISH = "[a-zA-ZáéíóúÁÉÍÓÚñÑüÜ]+"
_CELLS_ES = _CELLS.replace(_LATIN, _SPANISH)


def _scalar(tbl: str, expr: str) -> str:
    return f"SELECT id_review, {expr} AS out FROM {tbl}"


_B = rf"regexp_replace({strip(collapse('raw_text'))}, '{WS}+([.,;:!?])', '\1', 'g')"
_CTRL = r"[\x00-\x1f\x7f-\x{9f}]"
_RUNS = "raw_text"
for _p, _t in ((_CTRL, " "), (r"\.{4,}", "..."), (r"\?{4,}", "?"), (r"!{4,}", "!"), (f"{WS}+", " "), (rf"{WS}+([.,;:])", r"\1")):
    _RUNS = f"regexp_replace({_RUNS}, {q(_p)}, {q(_t)}, 'g')"
_MAP = "raw_text"
for _a, _b in en.SEQUENCES:
    _MAP = f"replace({_MAP}, {q(_a)}, {q(_b)})"


def fold(x: str, rules, flags: str = "g") -> str:
    for a, b in rules:
        x = f"regexp_replace({x}, {q(a.replace(chr(92) + 's', WS))}, {q(b.replace('$1', chr(92) + '1'))}, '{flags}')"
    return x


def cased(rules, upper: bool = True):
    """Each word rule as exact-case rules: all capitals, first capital, any other case."""
    for a, b in rules:
        if upper:
            yield rf"\b{a.upper()}\b", b.upper()
        yield rf"\b{a[0].upper()}(?i:{a[1:]})\b", b[:1].upper() + b[1:].lower()
        yield rf"(?i)\b{a}\b", b


_LETTERS = fold("final_clean_text", [("(?i)" + a, b) for a, b in ru.LETTERS])
_ASK = sorted({w.translate(str.maketrans("áéíóú", "aeiou")) for w in ru.INTERROGATIVES})
_GOOD = sorted({w.translate(str.maketrans("áéíóú", "aeiou")) for w in ru.AFFIRMATIONS})
_AMB = (
    " OR ".join(f"regexp_matches(final_clean_text, {q('(?i)' + p.replace(chr(92) + 's', WS).replace(chr(92) + 'b', f'(?:^|$|{_EDGE})', 1)[:-2] + f'(?:$|{_EDGE})')})" for p in ru.AMBIGUOUS)
    + f" OR len(list_filter(regexp_extract_all(coalesce(final_clean_text, ''), '{_LATIN}'), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '[aeiouáéíóúüAEIOUÁÉÍÓÚÜ]') AND NOT list_contains({lst(ru.ALLOWED_NO_VOWEL)}, lower(w)))) > 0"
)

ORACLES: dict[str, str] = {
    "emotion_correction": EMOTION + "SELECT id_review, rating_num, base_emotion, emotion FROM emo",
    "intensity_rows": INTENSITY + "SELECT id_review, rating_num, rating, emotion, intensity, override, saturated, score FROM lev",
    "intensity_distribution": INTENSITY + "SELECT intensity AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM lev), 2) AS pct FROM lev GROUP BY intensity",
    "incongruence_flags": INTENSITY
    + f""", why AS (SELECT *, CASE WHEN NOT coalesce(regexp_matches(emotion, '[^\\s\\p{{Z}}]'), false) THEN '' ELSE array_to_string(list_filter([
  CASE WHEN emotion = 'Alegría' AND r <= 2 THEN 'alegria_rating_bajo' END,
  CASE WHEN emotion IN ('Enojo', 'Tristeza', 'Asco', 'Miedo') AND r = 5 THEN lower(emotion) || '_rating_alto' END,
  CASE WHEN emotion = 'Neutral' AND r = 1 AND {said("coalesce(norm, '')", em.INTENSITY_POSITIVE)} THEN 'neutral_positivo_rating_bajo' END,
  CASE WHEN emotion = 'Neutral' AND r = 5 AND {said("coalesce(norm, '')", em.NEUTRAL_COMPLAINTS)} THEN 'neutral_negativo_rating_alto' END,
  CASE WHEN intensity = 1 AND r = 5 THEN 'intensidad_baja_rating_alto' END,
  CASE WHEN intensity = 4 AND r <= 2 THEN 'intensidad_alta_rating_bajo' END,
  CASE WHEN emotion = 'Enojo' AND intensity IN (1, 2) AND NOT {said("coalesce(norm, '')", em.MITIGATORS)} AND NOT {said("coalesce(norm, '')", em.DOUBTS)} THEN 'enojo_intensidad_baja' END,
  CASE WHEN emotion = 'Alegría' AND intensity = 4 AND NOT {said("coalesce(norm, '')", em.LOYALTY)} AND score < 4 THEN 'alegria_intensidad_extrema' END], lambda x: x IS NOT NULL), '; ') END AS incongruencia_motivo FROM lev)
SELECT id_review, rating_num, rating, intensity, incongruencia_motivo <> '' AS flag_incongruencia, incongruencia_motivo FROM why""",
    "normalize_b": _scalar("raw_reviews", _B),
    "normalize_a": f"SELECT id_review, CASE WHEN ends_with(b, '.') AND NOT ends_with(b, '...') THEN b[:-2] ELSE b END AS out FROM (SELECT id_review, {_B} AS b FROM raw_reviews)",
    "normalize_controls": _scalar("raw_reviews", strip(collapse(rf"regexp_replace(raw_text, '[\x00-\x1f\x7f-\x{{9f}}\x{{a0}}]', ' ', 'g')"))),
    "sanitize_text": _scalar("raw_reviews", strip(collapse(rf"regexp_replace(replace(coalesce(raw_text, ''), chr(65279), ''), '{_CTRL}', ' ', 'g')"))),
    "clean_runs": _scalar("raw_reviews", strip(_RUNS)),
    "strip_trailing_period": _scalar("raw_reviews", "CASE WHEN ends_with(raw_text, '.') AND length(raw_text) - length(replace(raw_text, '.', '')) = 1 THEN raw_text[:-2] ELSE raw_text END"),
    "accent_strip": _scalar("corrected", norm("final_clean_text")),
    "accent_strip_raw": _scalar("raw_reviews", norm("raw_text")),
    "alnum_signature": _scalar("raw_reviews", "lower(regexp_replace(raw_text, '[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+', '', 'g'))"),
    "length_metrics": r"SELECT id_review, length(raw_text) AS n_chars, len(regexp_extract_all(coalesce(raw_text, ''), '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+')) AS n_words FROM raw_reviews",
    "rating_value": f"SELECT id_review, rating, rating_num, coalesce({_RATING}, try_cast(nullif(regexp_extract(rating, '([0-9]+)', 1), '') AS integer)) AS value FROM complete",
    "first_text": "SELECT id_review, CASE " + " ".join(f"WHEN {_FULL(c)} THEN {c}" for c in ("text_after_sarcasm", "final_clean_text", "clean_text", "raw_text")) + " ELSE '' END AS out FROM corrected",
    "clip_for_model": "SELECT id_review, CASE WHEN length(s) < 2 THEN '[CORTO_O_VACIO]' ELSE left(s, 2000) END AS out FROM (SELECT id_review, " + strip("coalesce(raw_text, '')") + " AS s FROM raw_reviews)",
    "question_mark_clean": f"""WITH a AS (SELECT id_review, coalesce(raw_text, '') AS x, {norm("coalesce(raw_text, '')")} AS n FROM raw_reviews),
b AS (SELECT *, list_distinct(regexp_extract_all(n, '[a-z]+')) AS t FROM a),
c AS (SELECT id_review, {strip(f"CASE WHEN NOT regexp_matches(x, '[?¿]') OR list_has_any(t, {lst(_ASK)}) OR {said_ws('n', ['por que'])} THEN x WHEN len(t) <= 3 OR list_has_any(t, {lst(_GOOD)}) THEN regexp_replace(x, '[?¿]', '.', 'g') ELSE regexp_replace(x, '[?¿]{{3,}}', '.', 'g') END")} AS s FROM b)
SELECT id_review, CASE WHEN regexp_full_match(s, '(?:\\.|{WS})+') THEN '' ELSE s END AS out FROM c""",
    "ambiguous_flags": f"SELECT id_review, CASE WHEN final_clean_text IS NULL THEN NULL ELSE {_AMB} END AS out FROM complete",
    "ambiguous_resolution": f"""WITH o AS (SELECT id_review, max(text_pre_v7) AS t FROM corrected WHERE id_review <> '' GROUP BY id_review),
j AS (SELECT c.id_review, final_clean_text, coalesce(({_AMB}) AND t <> '' AND t <> final_clean_text, false) AS replaced, t FROM complete c LEFT JOIN o ON o.id_review = c.id_review)
SELECT id_review, CASE WHEN replaced THEN t ELSE final_clean_text END AS final_clean_text, replaced FROM j""",
    "sarcasm_score": _STRICT + "SELECT id_review, score, reason FROM s",
    "sarcasm_candidates_ranked": _STRICT + f"SELECT score, id_review, rating_num, rating, reason, final_clean_text AS text FROM s WHERE score >= {sa.REPORT_FROM}",
    "sarcasm_clean": _SARCASM_CLEAN,
    "sarcasm_audit": f"""SELECT count(*) AS rows, count(*) FILTER ({_TRUE}) AS possible_true, {_SAME('final_clean_text', 'text_after_sarcasm')} AS final_equals_after,
{_SAME('final_clean_text', 'clean_text_updated_after_sarcasm')} AS final_equals_updated, {_SAME('final_clean_text', 'clean_text_original_pre_sarcasm')} AS final_equals_original, {_SAME('text_after_sarcasm', 'clean_text_updated_after_sarcasm')} AS after_equals_updated FROM corrected""",
    "sarcasm_audit_values": "SELECT \"column\", value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {strip(c)} AS value FROM corrected" for c in ("sarcasm_action", "sarcasm_review_status", "sarcasm_action_final")) + ") WHERE value <> '' GROUP BY ALL",
    "sarcasm_consistency": f"""WITH a AS (SELECT {_TRUE} AS f, coalesce({strip('sarcasm_review_status')}, '') AS st, coalesce({strip('sarcasm_action')}, '') AS ac FROM corrected)
SELECT count(*) FILTER (f AND st <> 'requiere revisión manual') AS true_status, count(*) FILTER (f AND ac <> 'revisar') AS true_action, count(*) FILTER (NOT f AND st <> '' AND st <> 'sin revisión') AS false_status, count(*) FILTER (NOT f AND ac <> '' AND ac <> 'conservar') AS false_action FROM a""",
    "sarcasm_to_transform": "SELECT id_review, sarcasm_action_final FROM corrected WHERE lower(possible_sarcasm) = 'true' AND lower(sarcasm_action_final) = 'transformar'",
    "non_empty_counts": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({_FULL(c)}) AS n FROM corrected" for c in sa.COLUMNS),
    "mojibake_score": _scalar("raw_reviews", f"(length(raw_text) - length(regexp_replace(raw_text, '[{en.REWARDED}]', '', 'g'))) - (length(raw_text) - length(regexp_replace(raw_text, '[{en.SUSPICIOUS}]', '', 'g')))"),
    "mojibake_map": _scalar("raw_reviews", _MAP),
    "word_counts": _WORDS + " SELECT token, n FROM w",
    "vocabulary": _WORDS + f" SELECT token FROM w WHERE length(token) >= 3 AND NOT list_contains({lst(ru.DOMAIN_TERMS)}, token)",
    "bigram_counts": _CELLS + _PAIRS + _SPLIT_PAIRS + " SELECT t1, t2, n FROM p2",
    "no_vowel_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(final_clean_text, ''), '{_LATIN}')) AS token FROM corrected) WHERE length(token) >= 4 AND NOT regexp_matches(token, '[aeiouáéíóúüAEIOUÁÉÍÓÚÜ]') GROUP BY token",
    "no_vowel_tokens_detailed": f"SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(coalesce(final_clean_text, ''), '{_LATIN}'), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '[aeiouáéíóúüñAEIOUÁÉÍÓÚÜ]') AND NOT list_contains({lst(ru.DOMAIN_TERMS)}, lower(w)))[1:5]) AS token FROM corrected) GROUP BY token",
    "suspicious_characters": " UNION ALL ".join(f"SELECT '{c}' AS ch, coalesce(sum(length(coalesce(raw_text, '')) - length(replace(coalesce(raw_text, ''), '{c}', ''))), 0)::bigint AS n FROM raw_reviews" for c in ru.SUSPICIOUS_CHARACTERS),
    "mined_letter_rules": _CELLS_ES
    + f", w AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM cells) GROUP BY token)"
    + _PAIRS
    + f""", r AS (SELECT t1, t2, p.n, l.i, w.token AS word, w.n AS freq FROM p, (SELECT unnest({lst(ru.LETTERS_TO_TRY)}) AS c, unnest(range(0, {len(ru.LETTERS_TO_TRY)})) AS i) l JOIN w ON w.token = t1 || l.c || t2
WHERE p.n >= 3 AND w.n >= 3 AND length(t1) <= 15 AND length(t2) <= 8 AND NOT list_contains({lst(ru.LETTER_STOPWORDS)}, t1) AND NOT list_contains({lst(ru.LETTER_STOPWORDS)}, t2))
SELECT t1, t2, n, word, freq FROM r QUALIFY row_number() OVER (PARTITION BY t1, t2 ORDER BY freq DESC, i) = 1""",
    "mined_split_rules": _WORDS
    + _PAIRS
    + _SPLIT_PAIRS
    + f""", r AS (SELECT t1, t2, l.i, w.token AS word, w.n AS freq FROM p2, (SELECT unnest({lst(ru.LETTERS_TO_INSERT)}) AS c, unnest(range(0, {len(ru.LETTERS_TO_INSERT)})) AS i) l JOIN w ON w.token = t1 || l.c || t2
WHERE p2.n >= 2 AND length(t1) <= 4 AND length(t2) BETWEEN 2 AND 10 AND NOT list_contains({lst(ru.DOMAIN_TERMS)}, t1) AND NOT list_contains({lst(ru.DOMAIN_TERMS)}, t2)
AND coalesce((SELECT x.n FROM w x WHERE x.token = t1), 0) <= 3 AND coalesce((SELECT x.n FROM w x WHERE x.token = t2), 0) <= 3
AND length(w.token) >= 4 AND w.n >= 2 AND w.n >= p2.n * 2 AND NOT list_contains({lst(ru.DOMAIN_TERMS)}, w.token) AND regexp_matches(w.token, '[aeiouáéíóúü]'))
SELECT t1, t2, word FROM r QUALIFY row_number() OVER (PARTITION BY t1, t2 ORDER BY freq DESC, i) = 1""",
    "letter_repair": f"SELECT id_review, CASE WHEN f <> final_clean_text THEN {strip(collapse('f'))} ELSE final_clean_text END AS out FROM (SELECT id_review, final_clean_text, {_LETTERS} AS f FROM corrected)",
    "encoding_words": _scalar("corrected", fold("final_clean_text", cased(ru.ENCODING_WORDS))),
    "short_expansions": _scalar("corrected", fold("final_clean_text", [(rf"(?i)\b{a}\b", b) for a, b in ru.SHORT_EXPANSIONS])),
    "remove_emoji": _scalar("raw_reviews", r"regexp_replace(coalesce(raw_text, ''), '[\x{24C2}-\x{1F251}\x{2600}-\x{2B55}\x{10000}-\x{10FFFF}\x{200D}\x{231A}\x{23CF}\x{23E9}\x{3030}\x{FE0F}]+', ' ', 'g')"),
    "run_summary": f"""SELECT count(*) AS n, count(*) FILTER (NOT {_FULL('final_clean_text')}) AS n_blank, {', '.join(f'count(*) FILTER (intensity = {k}) AS n_level_{k}' for k in (1, 2, 3, 4))},
count(*) FILTER (flag_incongruencia) AS n_flagged, round(count(*) FILTER (flag_incongruencia) * 100.0 / greatest(count(*), 1), 2) AS flagged_pct FROM complete""",
    "edit1_by_ratio": f"""WITH w AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all({norm("coalesce(final_clean_text, '')")}, '[a-z]+')) AS token FROM corrected) GROUP BY token)
SELECT a.token, b.token AS word, damerau_levenshtein(a.token, b.token) AS d FROM w a JOIN w b ON abs(length(a.token) - length(b.token)) <= 1 WHERE b.n >= a.n * 10 AND damerau_levenshtein(a.token, b.token) <= 1""",
    "change_log": "SELECT id_review AS \"ID\", final_clean_text_original AS \"ANTES\", final_clean_text AS \"DESPUES\" FROM corrected WHERE final_clean_text IS DISTINCT FROM final_clean_text_original",
}
