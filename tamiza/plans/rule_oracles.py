"""DuckDB SQL of the rewriting stages: rules are folded over a list, one after the other."""

from __future__ import annotations

from tamiza.lexicons import rules as ru
from tamiza.operators import encoding as en
from tamiza.plans import review_oracles as ro
from tamiza.plans.review_oracles import WS, collapse, lst, norm, q, strip

_B = "\\b"
_NOT_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"


def _ws(p: str) -> str:
    return p.replace(r"\s", WS)


def fold_list(x: str, rules: list[tuple[str, str, str]]) -> str:
    """struct(t, n, c): text, replacements and names of the rules that fired. rules: pattern, replacement, name."""
    steps = "[" + ", ".join(f"{{'t': '', 'n': 0, 'c': []::varchar[], 'p': {q(p)}, 'r': {q(r)}, 'm': {q(m)}}}" for p, r, m in rules) + "]"
    none = f"{{'t': {x}, 'n': 0, 'c': []::varchar[], 'p': '', 'r': '', 'm': ''}}"
    hit = "regexp_matches(a.t, b.p)"
    return f"""list_reduce(list_prepend({none}, {steps}), lambda a, b: {{'t': regexp_replace(a.t, b.p, b.r, 'g'), 'n': a.n + len(regexp_extract_all(a.t, b.p)),
'c': CASE WHEN {hit} THEN list_append(a.c, b.m) ELSE a.c END, 'p': '', 'r': '', 'm': ''}})"""


def variants(rules, upper: bool = True):
    """Each rule for all capitals, a first capital and any case; a plain word's capitalised form has the rest small."""
    for p, to in rules:
        parts = p.split(r"\s+")
        join = lambda f: (WS + "+").join(map(f, parts))
        if upper:
            yield _B + join(str.upper) + _B, to.upper()
        any_case = join(lambda x: f"(?i:{x})")
        cap = to[:1].upper() + (to[1:] if len(parts) > 1 else to[1:].lower())
        yield f"{_B}{p[0].upper()}{any_case.replace('(?i:' + p[0], '(?i:', 1)}{_B}", cap
        yield f"(?i){_B}{join(str)}{_B}", to


# ---- D4: running counts -----------------------------------------------------
# Capitalised matches are replaced first; either way a replacement is counted once.
_SAFE = [(p, r, "") for a, b in ru.SAFE for p, r in variants([(a, b)], False)]
SAFE = lambda tbl: f"SELECT id_review, k.t AS text, CASE WHEN final_clean_text IS NOT NULL THEN k.n END AS n FROM (SELECT id_review, final_clean_text, {fold_list('final_clean_text', _SAFE)} AS k FROM {tbl})"


# ---- D1 to D3, K12: the corrector -------------------------------------------
def _ahead(p: str) -> tuple[str, int]:
    """A pattern with a look ahead as one that takes what it looks at, and the number of its group."""
    if "(?=" not in p:
        return p, 0
    head, rest = p.replace(r"(?!\s+ser)", "").split("(?=", 1)
    return head + "(" + rest, 1


def _corrector_rules():
    for p, to in [*ru.TORN_WORDS, *ru.SPELLING, *ru.CONTEXTS, *ru.ABBREVIATIONS]:
        if not any(c in "\\^$()|+*?[{" for c in p):
            p = _B + p + _B
        p, group = _ahead(p)
        yield _ws(p), to + (r"\1" if group else ""), "→" + to


_EMOJI = r"[\x{24C2}-\x{1F251}\x{2600}-\x{2B55}\x{10000}-\x{10FFFF}\x{200D}\x{231A}\x{23CF}\x{23E9}\x{3030}\x{FE0F}]+"


def _runs(x: str) -> str:
    for p, r in ((ro._CTRL, " "), (r"\.{4,}", "..."), (r"\?{4,}", "?"), (r"!{4,}", "!"), (WS + "+", " "), (rf"{WS}+([.,;:])", r"\1")):
        x = f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"
    return strip(x)


def sentences(x: str) -> str:
    """First letter, and letters behind a sentence end, as capitals."""
    x = f"upper(left({x}, 1)) || substr({x}, 2)"
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, {q(f'([.!?])({WS}*){c}')}, {q(chr(92) + '1' + chr(92) + '2' + c.upper())}, 'g')"
    return x


def corrected(tbl: str, columns: str) -> str:
    """(columns, final_clean_text, cambios) of a table."""
    start = f"lower(regexp_replace(coalesce(final_clean_text, 'nan'), {q(_EMOJI)}, ' ', 'g'))"
    return f"""SELECT {columns}, regexp_replace({sentences('r')}, '\\.{{2,}}$', '.') AS final_clean_text, cambios FROM (
SELECT {columns}, {_runs('k.t')} AS r, array_to_string(k.c, ' | ') AS cambios FROM (SELECT {columns}, {fold_list(start, list(_corrector_rules()))} AS k FROM {tbl}))"""


_WORDS = r"len(regexp_extract_all(final_clean_text, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+'))"
_WHY = ro.ORACLES["incongruence_flags"].rsplit("SELECT id_review", 1)[0]
_ANNOTATED = _WHY.replace("WITH a AS", "WITH fixed AS (" + corrected("complete", "id_review, rating, rating_num, base_emotion") + "), a AS").replace("base_emotion, " + norm("final_clean_text") + " AS norm, " + ro._RATING + " AS r FROM complete)", "base_emotion, " + norm("final_clean_text") + " AS norm, " + ro._RATING + " AS r FROM fixed)")

# ---- D10 to D14 --------------------------------------------------------------
_GUARD = ""


def chat(x: str) -> str:
    """D12. `x` behind `muy` is put out of reach and back. Words are told by what is around them, as a boundary between ASCII signs would part accented letters; each rule runs twice, since neighbours share what is between them."""
    word = lambda p, to, before="": (rf"(^|{_NOT_WORD}){before}{p}($|{_NOT_WORD})", rf"\1{to}\2" if not before else rf"\1\2{to}\3")
    for short, to in ru.CHAT_EXPANSIONS:
        cap, muy = to[:1].upper() + to[1:], rf"([mM][uU][yY]{WS}{{1,8}})"
        rules = [word("x", _GUARD, muy), word("X", _GUARD + _GUARD, muy)] if short == "x" else []
        if len(short) <= 2:
            rules += [(rf"^{short.upper()}($|{_NOT_WORD})", cap + r"\1"), (rf"([.!?]{WS}{{0,8}}){short.upper()}($|{_NOT_WORD})", r"\1" + cap + r"\2"), word(short.upper(), to)]
        else:
            rules += [word(short.upper(), to.upper()), word(short[0].upper() + "".join(f"[{c}{c.upper()}]" for c in short[1:]), cap)]
        if len(short) == 2:
            rules += [word(short[0].upper() + short[1], cap)]
        rules += [word(f"(?i:{short})", to)]
        for p, r in rules:
            for _ in range(2):
                x = f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"
        if short == "x":
            x = f"replace(replace({x}, '{_GUARD}{_GUARD}', 'X'), '{_GUARD}', 'x')"
    return x


def confused(x: str) -> str:
    """D13, D14."""
    alt = "|".join
    s, rules = WS + "+", []
    forms = (("COMPR", str.upper), ("Compr", str.capitalize), ("(?i:compr)", str))
    end = rf"({_NOT_WORD}|$)"  # a boundary between ASCII signs would end the word before an accented letter
    rules += [(rf"{_B}((?i:{alt(ru.COMPR_NOUN)})){s}{w}{end}", rf"\1 {f('compra')}\2") for w, f in forms]
    rules += [(rf"{_B}((?i:{alt(ru.COMPR_CLITICS)})){s}((?i:{alt(ru.COMPR_OBJECTS)})){s}{w}{end}", rf"\1 \2 {f('compré')}\3") for w, f in forms]
    rules += [(rf"{_B}((?i:{alt(ru.COMPR_OBJECTS)})){s}{w}{end}", rf"\1 {f('compré')}\2") for w, f in forms]
    rules += [(rf"{_B}{w}{s}((?i:{alt(ru.COMPR_DETERMINERS)})){end}", rf"{f('compré')} \1\2") for w, f in forms]
    rules += [(rf"{_B}((?i:yo)){s}{w}{end}", rf"\1 {f('compré')}\2") for w, f in forms]
    for p, r in [*rules, *variants(ru.CONFUSABLES)]:
        x = f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"
    return x


def encoded(x: str) -> str:
    for p, r in variants(ru.ENCODING_WORDS_CONTEXTUAL):
        x = f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"
    return x


# ---- E3 to E10: recoding -----------------------------------------------------
def _page(page: str) -> list[str]:
    return [bytes([b]).decode(page, "replace") for b in range(256)]


def _chars(page: str, to: str) -> tuple[list[str], list[str], str]:
    pairs = [(a, b) for a, b in zip(_page(page), _page(to)) if a != "�" and b != "�"]
    cls = "[" + "".join(f"\\x{{{ord(a):x}}}" for a, _ in pairs) + "]"
    return [a for a, b in pairs if a != b], [b for a, b in pairs if a != b], cls


def recoded(x: str, page: str, to: str) -> str:
    """NULL where a character is not of the page or the bytes say nothing."""
    a, b, cls = _chars(page, "latin-1" if to == "utf-8" else to)
    out = f"translate({x}, {q(''.join(a))}, {q(''.join(b))})" if a else x
    if to == "utf-8":
        out = f"TRY(decode(unhex(array_to_string(list_transform(string_split({out}, ''), lambda c: printf('%02x', ord(c))), ''))))"
    return f"CASE WHEN regexp_full_match({x}, {q('(?s)' + cls + '*')}) THEN {out} END"


def _score(x: str, bad: str) -> str:
    return f"((length({x}) - length(regexp_replace({x}, '[{en.REWARDED}]', '', 'g'))) - (length({x}) - length(regexp_replace({x}, '[{bad}]', '', 'g'))))"


def sanitised(src: str, x: str, every: bool) -> str:
    """Subquery (rid, out) over (rid, x): the best reading, then sequences, controls and spaces."""
    pages = [(p, o) for p in en.PAGES for o in ("utf-8", *[o for o in en.PAGES if o != p])] if every else [("latin-1", "utf-8"), ("cp1252", "cp850")]
    gate = r"[^\x00-\x7f]" if every else f"[{en.SUSPICIOUS}]"
    options = "[" + ", ".join(["t", *[recoded("t", p, o) for p, o in pages]]) + "]"
    m = "u"
    for a, b in en.SEQUENCES:
        m = f"replace({m}, {q(a)}, {q(b)})"
    return f"""(SELECT rid, {strip(collapse(f"regexp_replace({m}, {q(ro._CTRL)}, ' ', 'g')"))} AS out FROM (
SELECT rid, CASE WHEN regexp_matches(t, {q(gate)}) THEN list_reduce(list_filter({options}, lambda o: o IS NOT NULL), lambda a, b: CASE WHEN {_score('b', en.SUSPICIOUS)} > {_score('a', en.SUSPICIOUS)} THEN b ELSE a END) ELSE t END AS u
FROM (SELECT rid, regexp_replace(replace({x}, chr(160), ' '), '[\\x{{FEFF}}\\x{{FFFD}}]', '', 'g') AS t FROM {src})))"""


RAW_TEXT = ["id_review", "timestamp", "raw_text", "clean_text", "rating", "emotion", "intensity", "source", "product_id", "category", "marca", "modelo"]
_RID = lambda c: f"(SELECT row_number() OVER () AS rid, {c} AS x, id_review FROM raw_reviews)"


def _table_sql() -> str:
    """Each distinct value of a column is sanitised once, then put back."""
    ctes = ["r AS (SELECT * FROM raw_reviews)"] + [f"m_{c} AS (SELECT rid AS v, out FROM {sanitised(f'(SELECT DISTINCT {c} AS rid FROM r)', 'rid', False)})" for c in RAW_TEXT]
    return "WITH " + ",\n".join(ctes)


_SANITIZE = _table_sql() + " SELECT " + ", ".join(f"m_{c}.out AS {c}" for c in RAW_TEXT) + " FROM r " + " ".join(f"LEFT JOIN m_{c} ON m_{c}.v IS NOT DISTINCT FROM r.{c}" for c in RAW_TEXT)
_CHANGED = _table_sql() + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (r.{c} IS DISTINCT FROM m_{c}.out) AS changed FROM r LEFT JOIN m_{c} ON m_{c}.v IS NOT DISTINCT FROM r.{c}" for c in RAW_TEXT)

# ---- pairs of short words, X25, A19, K11 --------------------------------------
_LETTER = "[A-Za-zÀ-ÿ]"
# A pair begins and ends at a word's edge; matches do not overlap. What stands before a match is cut off with it.
_SHORT = f"list_transform(regexp_extract_all(' ' || regexp_replace(coalesce(final_clean_text, ''), {q('(' + _NOT_WORD + ')')}, {q(chr(92) + '1' + chr(92) + '1')}, 'g') || ' ', {q(f'{_NOT_WORD}({_LETTER}{{1,4}}{WS}+{_LETTER}{{2,10}}){_NOT_WORD}')}, 1), lambda x: {collapse('x')})"
_FOUND = f"SELECT row_number() OVER () AS rid, id_review, {_SHORT} AS f FROM corrected"
REGEX_PAIRS = f"SELECT lower(pair) AS pair, count(*) AS n FROM (SELECT unnest(f) AS pair FROM ({_FOUND})) GROUP BY 1"

_MISSING = (
    ro._WORDS
    + f""", vocab AS (SELECT token FROM w WHERE length(token) >= 3 AND NOT list_contains({lst(ru.DOMAIN_TERMS)}, token)),
f AS ({_FOUND}), s AS (SELECT rid, id_review, unnest(range(1, len(f) + 1)) AS pos, unnest(f) AS p FROM f),
h AS (SELECT rid, id_review, pos, split_part(p, ' ', 1) AS t1, split_part(p, ' ', 2) AS t2 FROM s),
l AS (SELECT unnest({lst(ru.LETTERS_MISSING)}) AS c, unnest(range(0, {len(ru.LETTERS_MISSING)})) AS i),
b AS (SELECT l1, l2, arg_min(token, i) AS candidate FROM (SELECT DISTINCT lower(t1) AS l1, lower(t2) AS l2 FROM h WHERE NOT list_contains({lst(ru.DOMAIN_TERMS)}, lower(t1)) AND NOT list_contains({lst(ru.DOMAIN_TERMS)}, lower(t2))), l JOIN vocab ON token = l1 || c || l2 GROUP BY ALL),
mp AS (SELECT rid, id_review, pos, t1, t2, candidate FROM h JOIN b ON lower(t1) = l1 AND lower(t2) = l2)
"""
)
_BARE = f"list_filter(regexp_extract_all(coalesce(final_clean_text, ''), '{_LETTER}+'), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '[aeiouáéíóúüñAEIOUÁÉÍÓÚÜ]') AND NOT list_contains({lst(ru.DOMAIN_TERMS)}, lower(w)))[1:5]"
_REVISION = (
    _MISSING
    + f""", t AS (SELECT id_review AS id, row_number() OVER (PARTITION BY rid ORDER BY pos) - 1 AS k, t1 || ' ' || t2 || ' → ' || candidate AS finding FROM mp),
v AS (SELECT id_review AS id, unnest(range(0, len(f))) AS k, unnest(f) AS finding FROM (SELECT id_review, {_BARE} AS f FROM corrected))
SELECT id, 'torn_pair' AS kind, k, finding FROM t WHERE k < 5 UNION ALL SELECT id, 'no_vowel', k, finding FROM v"""
)

# ---- N4 ----------------------------------------------------------------------
_BATCHES = f"""WITH a AS (SELECT id_review AS id, left({strip("coalesce(max(raw_text), '')")}, 2000) AS text FROM raw_reviews GROUP BY id_review),
b AS (SELECT *, greatest(1, cast(ceil((SELECT count(*) FROM a WHERE length(text) >= 2) / 3000.0) AS bigint)) AS n FROM a WHERE length(text) >= 2),
c AS (SELECT id, text, cast('0x' || left(md5(id), 8) AS bigint) % n AS bucket FROM b),
d AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY id, text) - 1) // 30 AS batch FROM c)
SELECT bucket, batch, '{{"lote":[' || string_agg('{{"id":' || cast(to_json(id) AS varchar) || ',"text":' || cast(to_json(text) AS varchar) || '}}', ',' ORDER BY id, text) || ']}}' AS lote FROM d GROUP BY ALL"""

_NORM_B = lambda x: rf"regexp_replace({strip(collapse(x))}, '{WS}+([.,;:!?])', '\1', 'g')"
_CONTEXT = confused(chat(encoded(_NORM_B("raw_text"))))

# ---- D6, D7, D9: mined rules applied ------------------------------------------
_ONE = "{'t': t, 'p': '', 'r': ''}"
_LETTERS_MINED = f"""WITH rules AS ({ro.ORACLES['mined_letter_rules']}),
steps AS (SELECT coalesce(list({{'t': '', 'p': '(?i){_B}' || t1 || '{WS}+' || t2 || '{_B}', 'r': word}} ORDER BY n DESC, t1, t2), []) AS s FROM rules),
f AS (SELECT id_review, final_clean_text, {ro._LETTERS} AS t FROM corrected),
g AS (SELECT id_review, final_clean_text, list_reduce(list_prepend({_ONE}, (SELECT s FROM steps)), lambda a, b: {{'t': regexp_replace(a.t, b.p, b.r, 'g'), 'p': '', 'r': ''}}).t AS t FROM f)
SELECT id_review, CASE WHEN t <> final_clean_text THEN {strip(collapse('t'))} ELSE t END AS final_clean_text FROM g"""

# A scan over words and what stands between: a short pair is taken with both its words, whether a rule knows it or not.
_PAIR_AT = f"regexp_full_match(tk[i], '{_LETTER}{{1,4}}') AND regexp_full_match(coalesce(tk[i + 1], ''), '[ \\t]+') AND regexp_full_match(coalesce(tk[i + 2], ''), '{_LETTER}{{2,10}}')"
_TO = "list_filter(rs, lambda x: x.k = lower(tk[i]) || ' ' || lower(tk[i + 2]))[1].w"
_CASED = f"CASE WHEN {_TO} IS NULL THEN tk[i] || ' ' || tk[i + 2] WHEN regexp_matches(tk[i], '^\\p{{Lu}}') THEN upper(left({_TO}, 1)) || lower(substr({_TO}, 2)) ELSE {_TO} END"
_AT = "list_transform(range(1, len(tk) + 1), lambda i: {'o': CASE WHEN " + _PAIR_AT + " THEN " + _CASED + " ELSE tk[i] END, 's': CASE WHEN " + _PAIR_AT + " THEN 3 ELSE 1 END, 'i': i::bigint})"
_SPLITS_MINED = f"""WITH rules AS ({ro.ORACLES['mined_split_rules']}), l AS (SELECT coalesce(list({{'k': t1 || ' ' || t2, 'w': word}}), []) AS rs FROM rules),
a AS (SELECT id_review, {strip('final_clean_text')} AS t FROM corrected),
b AS (SELECT id_review, t, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+') AS tk, rs FROM a, l),
c AS (SELECT id_review, t, {_AT} AS p FROM b),
d AS (SELECT id_review, CASE WHEN t IS NULL THEN NULL ELSE list_reduce(list_prepend({{'o': '', 's': 1::bigint, 'i': 0::bigint}}, list_transform(p, lambda x: {{'o': x.o, 's': x.s::bigint, 'i': x.i}})),
  lambda a, b: CASE WHEN b.i < a.s THEN a ELSE {{'o': a.o || b.o, 's': b.i + b.s, 'i': 0::bigint}} END).o END AS u FROM c)
SELECT id_review, {strip(collapse("CASE WHEN ends_with(u, '.') AND length(u) - length(replace(u, '.', '')) = 1 THEN u[:-2] ELSE u END"))} AS final_clean_text FROM d"""

# ---- D19: unknown words take the nearest known one -----------------------------
_ES = "[a-záéíóúüñ]+"
# Distances are taken over bytes, so every letter gets to be one.
_BYTES = lambda x: f"translate({x}, 'áéíóúüñ', '1234567')"
_EXPANDED = "base"
for _p, _r in [*variants(ru.ENCODING_WORDS), *[(rf"(?i){_B}{a}{_B}", b) for a, b in ru.SHORT_EXPANSIONS]]:
    _EXPANDED = f"regexp_replace({_EXPANDED}, {q(_p)}, {q(_r)}, 'g')"
_AUDIT = f"""WITH b AS (SELECT row_number() OVER () AS rid, id_review, final_clean_text AS f, CASE {' '.join(f"WHEN {ro._FULL(c)} THEN {c}" for c in ('text_after_sarcasm', 'final_clean_text', 'clean_text', 'raw_text'))} ELSE '' END AS base FROM corrected),
t AS (SELECT rid, id_review, f, CASE WHEN base <> '' THEN {_EXPANDED} END AS t FROM b),
w AS (SELECT token AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(final_clean_text, '')), '{_ES}')) AS token FROM complete) GROUP BY token),
k AS (SELECT word, sum(n) AS n FROM (SELECT word, n FROM w WHERE n * 1e6 >= 20.0 * (SELECT sum(n) FROM w) UNION ALL SELECT unnest({lst(ru.PROTECTED_TERMS)}), 1) GROUP BY word),
p AS (SELECT rid, unnest(x) AS part, unnest(range(len(x))) AS pos FROM (SELECT rid, regexp_extract_all(t, '(?i){_ES}|[^{_ES[1:]}') AS x FROM t)),
u AS (SELECT DISTINCT lower(part) AS token FROM p WHERE regexp_matches(part, '(?i)^{_ES}$') AND part <> upper(part) AND length(part) > 2 AND NOT list_contains({lst(ru.PROTECTED_TERMS)}, lower(part)) AND lower(part) NOT IN (SELECT word FROM k)),
n AS (SELECT token, word FROM (SELECT token, word, n, damerau_levenshtein({_BYTES('token')}, {_BYTES('word')}) AS d FROM u JOIN k ON abs(length(token) - length(word)) <= 2) WHERE d <= 2 QUALIFY row_number() OVER (PARTITION BY token ORDER BY d, n DESC, word) = 1),
c AS (SELECT rid, pos, CASE WHEN word IS NULL THEN part WHEN part = upper(part) AND length(part) > 1 THEN upper(word) WHEN part[1] = upper(part[1]) THEN upper(word[1]) || word[2:] ELSE word END AS part FROM p LEFT JOIN n ON lower(part) = token),
o AS (SELECT rid, string_agg(part, '' ORDER BY pos) AS x FROM c GROUP BY rid),
a AS (SELECT t.rid, id_review, f, CASE WHEN t IS NOT NULL THEN {_NORM_B("coalesce(x, '')")} END AS y FROM t LEFT JOIN o ON o.rid = t.rid)
SELECT id_review, coalesce(CASE WHEN ends_with(y, '.') AND NOT ends_with(y, '...') THEN y[:-2] ELSE y END, f) AS final_clean_text FROM a"""

ORACLES: dict[str, str] = {
    "deep_audit": _AUDIT,
    "letter_repair_mined": _LETTERS_MINED,
    "mined_repair": _SPLITS_MINED,
    "safe_corrections": SAFE("corrected"),
    "correct_corpus": f"SELECT id_review, final_clean_text, cambios, length(final_clean_text) AS clean_length_chars, {_WORDS} AS clean_length_words FROM ({corrected('corrected', 'id_review')})",
    "correction_report": f"SELECT id_review AS id, cambios FROM ({corrected('corrected', 'id_review')}) WHERE cambios <> ''",
    "annotated_reviews": _ANNOTATED + "SELECT id_review, final_clean_text, emotion, intensity, incongruencia_motivo <> '' AS flag_incongruencia, incongruencia_motivo FROM why",
    "chat_expansions": f"SELECT id_review, {chat('final_clean_text')} AS out FROM corrected",
    "confusables": f"SELECT id_review, {confused('final_clean_text')} AS out FROM corrected",
    "capitalize_sentences": f"SELECT id_review, {sentences('raw_text')} AS out FROM raw_reviews",
    "mojibake_fix": f"WITH r AS {_RID('raw_text')} SELECT id_review, out FROM r JOIN {sanitised('r', 'x', False)} USING (rid)",
    "mojibake_fix_all_pages": f"WITH r AS {_RID('raw_text')} SELECT id_review, out FROM r JOIN {sanitised('r', 'x', True)} USING (rid)",
    "sanitize_table": _SANITIZE,
    "mojibake_changed_cells": _CHANGED,
    "regex_pair_counts": REGEX_PAIRS,
    "top_pairs": REGEX_PAIRS + " ORDER BY n DESC, pair LIMIT 20",
    "missing_letter_pairs": _MISSING + "SELECT id_review AS id, t1, t2, candidate FROM mp",
    "revision_report": _REVISION,
    "contextual_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower({_CONTEXT}), '[a-záéíóúüñ]+')) AS token FROM raw_reviews WHERE {ro._FULL('raw_text')}) GROUP BY token",
    "llm_batches": _BATCHES,
}
