"""Word lists of the sarcasm rules. Fixed values; the loose and the strict detector differ on purpose."""

POSITIVE_LOOSE = "excelente perfecto increible maravilloso fantastico genial buenisimo recomendable bueno".split()
POSITIVE_STRICT = "excelente perfecto increible maravilloso fantastico genial buenisimo recomendable buen bueno buena".split()
POSITIVE_PHRASES = ["muy bueno", "muy buena", "super bien", "vale la pena"]
NEGATIVE = "lento lenta calienta calentamiento bateria pila pantalla teclado falla fallo ruidoso traba congela defecto problema malo mala".split()
NEGATIVE_PHRASES = ["no sirve", "no enciende", "no carga", "se traba", "se congela", "no funciona", "muy lento", "muy lenta"]
TECHNICAL = "bateria pila pantalla teclado calienta calentamiento ruidoso ventilador temperatura".split()
CONTRASTS = ["pero", "aunque", "sin embargo", "a pesar de", "no obstante"]
CUES = ["jajaja", "jaja", "jeje", "ja", "ajaja", "uff", "aja", "sarcasmo", "claro", "si claro", "como no"]
IRONY = ["pisapapeles", "tirar el dinero", "para tirar el dinero", "freir un huevo", "gracias por nada", "para la basura", "de adorno", "excelente para tirar"]
QUOTED = ["excelente", "perfecto", "increible", "genial", "buenisimo", "recomendable"]
REPORT_FROM = 4
COLUMNS = (
    "possible_sarcasm sarcasm_reason sarcasm_action sarcasm_review_status text_after_sarcasm clean_text_original_pre_sarcasm "
    "sarcasm_manual_decision sarcasm_processing_notes sarcasm_action_final clean_text_updated_after_sarcasm"
).split()
STRICT_CUES = ["si claro", "claro que si", "como no", "aja", "aja si", "seguro que si"]
TAGS = ["sarcasmo", "sarcastico", "sarcastica", "sarcastic", "ironia", "ironico", "ironica"]
