"""Fixed values that scores depend on: word lists, phrases, TeX names. They are data and must stay as they are."""

import json

STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the their this to was we with".split()

ABSTRACT_WORDS = (
    "important noteworthy significant crucial valuable robust framework approach methodology perspective insight highlights "
    "demonstrates illustrates leverages facilitates comprehensive novel effective substantial promising various multiple"
).split()

VAGUE_WORDS = [w for w in ABSTRACT_WORDS if w != "demonstrates"]

DISCOURSE_MARKERS = "additionally furthermore moreover consequently therefore notably overall importantly specifically".split()

ABBREVIATIONS = "al cf dr eq e.g etc fig i.e mr mrs ms prof sec st vs".split()

BOILERPLATE = [
    "in this paper",
    "the remainder of this paper",
    "related work",
    "experimental results",
    "results show",
    "we evaluate",
    "our method",
    "this section",
]

PHRASES = {
    "empty_transition": ["it is important to note", "it is worth noting", "it should be noted", "in order to", "moreover", "furthermore", "additionally", "overall,"],
    "framework_boilerplate": ["robust framework", "valuable framework", "comprehensive framework", "effective framework", "plays a crucial role", "provides a valuable", "offers a novel", "important avenue"],
    "novelty_inflation": ["state-of-the-art", "novel paradigm", "highly effective", "significant potential", "substantial promise", "compelling results"],
    "unsupported_confidence": ["clearly demonstrates", "conclusively shows", "it is evident that", "undoubtedly", "without question", "proves that"],
    "balanced_but_empty_summary": ["these findings highlight", "this underscores the importance", "the results demonstrate that", "this suggests that", "this highlights the fact that"],
}

#: What a phrase category counts as.
CANONICAL = {
    "empty_transition": "empty_transition",
    "framework_boilerplate": "framework_boilerplate",
    "novelty_inflation": "unsupported_confidence",
    "unsupported_confidence": "unsupported_confidence",
    "balanced_but_empty_summary": "balanced_summary",
}

#: TeX environments that are replaced whole, in this order, and commands that yield their argument.
BLOCK_ENVIRONMENTS = "equation equation* align align* gather gather* multline multline* figure figure* table table* tikzpicture lstlisting verbatim".split()
INLINE_COMMANDS = "emph textbf textit underline textrm textsf texttt mbox url href".split()


def read_phrases(path: str) -> dict[str, list[str]]:
    """Phrases by category from a JSON file, an object of lists of texts."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict) or not all(isinstance(v, list) and all(isinstance(p, str) for p in v) for v in found.values()):
        raise ValueError(f"{path} is not an object of lists of phrases")
    return found
