"""Features asked for per conversation: their kind, vocabulary, and the names they come under."""

from dataclasses import dataclass

NOT_AVAILABLE = "NA"

CLOSED = "closed"
CLOSED_LIST = "closed_list"
OPEN_LIST = "open_list"
TEXT = "text"

# Texts that stand for a value that was not given. NA is a label, not one of them.
MISSING_TOKENS = ("nan", "NaN")


@dataclass(frozen=True)
class Feature:
    """``aliases`` are other names, or dotted paths, under which a response may give the feature."""

    name: str
    kind: str
    vocabulary: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()

    @property
    def is_list(self) -> bool:
        return self.kind in (CLOSED_LIST, OPEN_LIST)

    @property
    def allowed(self) -> tuple[str, ...]:
        """Vocabulary and the label for features that cannot be told."""
        return (*self.vocabulary, NOT_AVAILABLE)


# Feature names and levels of the Italian annotation scheme.
_EMOTIONS = ("Neutralità", "Rabbia", "Tristezza", "Sorpresa", "Gioia", "Paura")
_TONES = ("Neutrale", "Emotivo", "Ironico", "Sarcastico")
DEFAULT_FEATURES = (
    Feature(
        "Risoluzione_richiesta",
        CLOSED,
        ("Risolto", "Non risolto", "Non risolvibile"),
        ("Risoluzione_richiesta_cliente",),
    ),
    Feature(
        "Soddisfazione_cliente",
        CLOSED,
        ("Molto insoddisfatto", "Insoddisfatto", "Neutrale", "Soddisfatto", "Molto soddisfatto"),
        ("Percezione_soddisfazione_cliente",),
    ),
    Feature(
        "Emozioni_cliente",
        CLOSED_LIST,
        _EMOTIONS,
        ("Emozioni cliente", "Emozioni.Cliente", "Emozione_prevalente_cliente"),
    ),
    Feature(
        "Emozioni_operatore",
        CLOSED_LIST,
        _EMOTIONS,
        ("Emozioni operatore", "Emozioni.Operatore", "Emozione_prevalente_operatore"),
    ),
    Feature(
        "Tono_cliente",
        CLOSED,
        _TONES,
        ("Tono cliente", "Tono.Cliente", "Tono_conversazione_cliente"),
    ),
    Feature(
        "Tono_operatore",
        CLOSED,
        _TONES,
        ("Tono operatore", "Tono.Operatore", "Tono_conversazione_operatore"),
    ),
    Feature("Livello_linguistico_cliente", CLOSED, ("Scarso", "Medio", "Alto")),
    Feature("Argomento_conversazione", OPEN_LIST, aliases=("Argomento_della_conversazione",)),
    Feature("Riassunto_conversazione", TEXT, aliases=("Riassunto",)),
)

#: Rules that put a topic into a class: the first one whose regex occurs, ignoring case, decides.
# Regexes, class names and their order.
DEFAULT_TOPIC_RULES = (
    ("Bonus", "[Bb]onus*"),
    ("Assistenza giochi", "[Aa]ssistenza gioc*"),
    ("Registrazione", "[Rr]egistrazion*"),
    ("Operatore", "[Oo]perator*"),
    ("Prelievi", "[Pp]reliev*"),
    ("Conto", "[Cc]onto*"),
    ("Ricarica", "[Rr]icaric*"),
    ("Gioco Responsabile", "[Gg]ioco [rR]esponsabile*"),
)
DEFAULT_OTHER_TOPIC = "Altro"

# How annotators write the main emotion, and tones they use beyond the scheme.
PRIMARY_EMOTION_PATTERN = "Emozione primaria: (.+?);"
ANNOTATOR_TONES = {"Formale": "Neutrale", "Informale": "Neutrale"}
ANNOTATOR_EXTRA_COLUMNS = ("Livello_linguistico_operatore", "Adeguatezza_competenza_operatore")


def alias_map(features: tuple[Feature, ...]) -> dict[str, str]:
    """Every alias with the name it stands for."""
    return {alias: f.name for f in features for alias in f.aliases}
