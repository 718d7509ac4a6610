"""Document language by frequent function words: a plain vote as a Column, English if nothing speaks for another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A few very frequent words of each language; scripts of their own decide first.
WORDS = {
    "en": "the of and to in is that it was for on are with as his they at be this from have or by".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "le la les des et est une dans que qui pour pas sur au plus par avec ce ne".split(),
    "es": "el los las del que y en un una por con para como más pero sus al lo".split(),
    "it": "il di che è la per un con non una sono del della nel si da come più".split(),
    "pt": "o os que do da em um para com não uma por mais as dos como mas ao".split(),
    "nl": "de het een van en dat niet zijn op te met voor er maar om dit".split(),
}
SCRIPTS = {"ja": r"[\x{3040}-\x{30ff}]", "ko": r"[\x{ac00}-\x{d7af}]", "zh": r"[\x{4e00}-\x{9fff}]", "ru": r"\p{IsCyrillic}", "ar": r"\p{IsArabic}"}


def _among(words: list[str]):
    return lambda w: w.isin(words)


def language(text: Column, least: int = 1) -> Column:
    """ISO code; ``least`` is the number of characters below which the answer is English."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    votes = {code: F.size(F.filter(words, _among(own))) for code, own in WORDS.items()}
    best = F.greatest(*votes.values())
    out = F.lit("en")
    for code in reversed(list(WORDS)):
        out = F.when((votes[code] == best) & (best > 0), F.lit(code)).otherwise(out)
    for code in reversed(list(SCRIPTS)):
        out = F.when(F.length(F.regexp_replace(text, "(?U)[^" + SCRIPTS[code].strip("[]") + "]", "")) * 4 > F.length(text), F.lit(code)).otherwise(out)
    return F.when(F.length(F.trim(text)) < least, F.lit("en")).otherwise(out)
