"""Word lists of the emotion and intensity rules. They decide the results."""

LABELS = {"joy": "Alegría", "sadness": "Tristeza", "anger": "Enojo", "surprise": "Sorpresa", "disgust": "Asco", "fear": "Miedo", "others": "Neutral"}

NEGATIONS = "no nunca jamas cero sin ningun ninguna".split()

CONTRASTS = ["pero", "aunque", "sin embargo", "a pesar de", "no obstante", "empero", "salvo"]

POSITIVE = (
    "excelente bueno buena buen recomendado recomendable recomiendo perfecto perfecta encantada encantado encanta encanto genial increible maravilloso "
    "maravillosa fantastico cumple cumplio util agradable satisfecho satisfecha feliz contento contenta amor amo funcional funciona funciono veloz rapida rapido "
    "ideal practica practico expectativas espectativas"
).split()

NEGATIVE = (
    "calienta caliento calentamiento congela congelo defectuoso defectuosa error fallo falla lag lento lenta pantallazo problema ruido ruidoso ruidosa "
    "rompio sobrecalent traba trabo apaga apago reinicio reinicia decepcion decepcionado decepcionada roto rota inservible inutil malo mala pesimo pesima "
    "terrible horrible basura mierda"
).split()

HARDWARE = "bateria pantalla teclado ventilador temperatura gpu cpu ram ssd disco cargador speaker bocina camara touchpad mouse".split()

NEGATIVE_ADJECTIVES = "ruidoso ruidosa lento lenta malo mala defectuoso defectuosa corto corta poco insuficiente bajo baja debil fragil barato barata".split()

SADNESS = "triste tristeza lament pena decepcion lastima arrepent frustrad decepcionad desilusionad".split()

STRONG_NEGATIVE = [
    "no sirve", "no funciona", "no funciono", "no enciende", "no encendio", "no prende", "no prendio", "no carga", "no cargo", "no da video",
    "no reconoce", "no detecta", "no recomiendo", "no recomendaria", "no compre", "no compraria", "falla grave", "fallo grave",
    "pantalla azul", "pantalla negra", "pantalla blanca", "pantalla rota", "pantalla rayada", "dinero perdido",
    "perdi mi dinero", "no es bueno", "no es buena", "no es perfecto", "no es perfecta", "no esta bueno", "no esta buena",
]

NEGATABLE = ["se congela", "se congelo", "se reinicia", "se reinicio", "se traba", "se trabo", "se rompe", "se rompio", "se apaga", "se apago"]

CATASTROPHES = ["fuego", "humo", "chispa"]
CATASTROPHE_STEMS = ["explot", "incendi", "quem"]

REPORTING = "dicen comentan coment mencion segun algunos escuche lei vi leyeron escuchado".split()

#: Where base Sorpresa is joy after all, and what speaks for surprise.
POSITIVE_QUESTION = r"¿?{ws}*\b(?:excelente|bien|bueno)\b(?:,|{ws})*\?+"
SURPRISE = r"sorprend|inesper|no{ws}+esperab|no{ws}+me{ws}+esperab|jamas{ws}+imagin|increible(?:,|:|{ws})+que"

# Intensity.
MITIGATORS = ["un poco", "algo", "ligeramente", "casi", "medio", "mas o menos", "regular", "normalito", "normalita"]
DOUBTS = ["creo que", "parece que", "tal vez", "quizas", "no se", "me parece", "supongo"]
INTENSIFIERS = "muy super bastante demasiado altamente sumamente extremadamente realmente totalmente absolutamente completamente definitivamente mucho".split()
ABSOLUTES = "excelente pesimo horrible maravilloso maravillosa encanta encanto odio perfecto perfecta increible fantastico genial terrorifico espantoso espantosa".split()
DETERMINERS = "nunca siempre jamas nada todo todos ningun ninguna".split()
INTENSITY_POSITIVE = "bueno buena excelente recomendado recomendable encanta encanto perfecto perfecta increible cumple util genial fantastico maravilloso maravillosa".split()
LEGAL = "profeco demanda abogado fraude estafa robo denuncia fiscalia juicio querella".split()
FINANCIAL = ["reembolso", "devolucion", "quiero mi dinero", "exijo reembolso", "reembolsen", "devuelvanme", "dinero perdido"]
LOYALTY = [
    "me cambia la vida", "mejor producto de la historia", "compraria mil", "compraria mil mas", "compraria 1000", "la mejor compra", "el mejor producto", "nunca mejor inversion",
]
PROFANITY = "mierda basura idiota pendejo estupido pinche verga culero huevon puta puto".split()
PROFANITY_STEMS = ["ching"]
#: The score from which intensity is 4.
SATURATION = 4
NEUTRAL_COMPLAINTS = ["malo", "mala", "falla", "problema"]
