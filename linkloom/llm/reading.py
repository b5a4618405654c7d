"""Reading level of documents on the bands of sample texts.

The prose of each document is separated from headings, code, traces, logs, tables, links and bracketed references. Vocabulary
demand is the coverage rank: the smallest rank of a frequency-ranked vocabulary whose words cover a fixed share of the
document's words. Sentence complexity is words per sentence. Both are calibrated in SQL against the sample texts, whose
bands give a straight scale and the cuts on it.

The vocabulary is a public one, that of a byte-pair tokenizer: pieces were merged in order of their frequency in general
text, so the place of a word is its frequency rank, and a word of several pieces comes after all words of one. Ranks counted
in the collection itself say how common a word is there, not how demanding it is. A document that lies close to a cut, where
neighbouring bands of sample texts overlap, is checked on a second scale that has the syllables per word beside both.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut, spread
from . import tokens

#: Parameters with their meanings.
LEAST_WORDS = 40  # of running prose
COVERED = 0.85  # share of a document's words that the vocabulary must cover
CLOSE = 0.3  # distance to a cut, in bands, below which the second scale decides

_FENCE = re.compile(r"^\s{0,3}(```+|~~~+)")
_LIST = re.compile(r"^\s{0,12}(?:[-*+•–]|\(?\d{1,3}[.)]|[a-zA-Z][.)])\s+(?:\[[ xX]\]\s+)?")
_HEADING = re.compile(r"^\s{0,3}(?:#{1,6}\s|={1,6}\s|[A-Z]{2,10}-\d+\b|(?:Subject|Betreff|Title|Titel|From|To|Cc|Date)\s*:)")
#: Marks of copies and replies before the first line.
_PREFIX = re.compile(r"\A\s*(?:(?:\[\w+\]|(?:Re|RE|Fwd|FW|Fw|AW|WG)\s*:)\s*)+")
_RULE = re.compile(r"^\s*(?:[-=_*~+#]\s*){3,}$")
_TABLE = re.compile(r"^\s*\|.*\|?\s*$|^\s*\+[-=+]+\+\s*$|\t.*\t|\S\s*\|\s*\S.*\|\s*\S")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d[.,\]]|(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b[\s:\[])")
_TRACE = re.compile(r"^\s*(?:at\s+[\w.$<>]+\s*\(|Caused by:|\.\.\. \d+ more|Traceback \(|File \"|[\w.$]+(?:Exception|Error)\b(?::|$)|Exception in )")
#: The same for lines that begin with a letter.
_WORDY = re.compile("|".join(f"(?:{r.pattern})" for r in (_HEADING, _LOG, _TRACE)))
_LINK = re.compile(r"(?:https?|ftp|file)://\S+|www\.\S+\.\S+|\S+@\S+\.\w+")
_DATA = re.compile(r"^\s*[{\[<].*[}\]>],?\s*$|^\s*[}\])]+[;,]?\s*$|^\s*<\?|^\s*</?\w+[^>]*>\s*$")
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:import|package|#include|def|function|return|public|private|static|var|const|let)\b.*[;:{(]\s*$|^\s*[$>]\s*\w+|\w+\([^()]*\)\s*[;{]")
_REFERENCE = re.compile(r"\s*\((?:see|cf\.?|siehe|vgl\.?|ref\.?)\s[^()]*(?:\([^()]*\)[^()]*)*\)|\s*\[[^\[\]]*\](?:\([^()]*\))?|\s*\((?:[A-Z]{2,}-\d+|\d{4})\)", re.I)
_INLINE = re.compile(r"`[^`]*`")
#: Numbers are words too; the vocabulary holds them as one.
_WORD = re.compile(r"[^\W_]+(?:[.,'’-][^\W_]+)*")
_END = re.compile(r"[.!?…]+[\"')\]]*(?:\s|$)")
_VOWELS = re.compile(r"[aeiouy]+")
#: Common words that tell the language.
_ENGLISH = frozenset("the of to and a in is that for it with as on be this by are from at or not no may can will each our we they there which if when while because must should its".split())
_GERMAN = frozenset("der die das und ist nicht mit ein eine einer eines zu den dem des von im auf für wird werden wir sich als auch bei jede jeder jedes oder wenn sonst vor genau haben bitte ohne dass nach".split())


@lru_cache(maxsize=1 << 16)
def syllables(word: str) -> int:
    n = 0
    for part in re.split(r"['’-]", word):
        if not part:
            continue
        k = len(_VOWELS.findall(part))
        if part.endswith("e") and not part.endswith("le") and k > 1:
            k -= 1
        n += max(1, k)
    return max(1, n)


def prose_units(text: str | None) -> list[str]:
    """Paragraphs and list items of running prose, each joined to one line."""
    units: list[str] = []
    fence = ""
    block: list[str] = []

    def flush() -> None:
        if not block:
            return
        current: list[str] = []
        items: list[tuple[bool, str]] = []
        for line in block:
            bullet = _LIST.match(line)
            if bullet:
                if current:
                    items.append((items_list[0], " ".join(current)))
                current = [line[bullet.end() :].strip()]
                items_list[0] = True
            else:
                current.append(line.strip())
        if current:
            items.append((items_list[0], " ".join(current)))
        items_list[0] = False
        single = len(items) == 1 and not items[0][0]
        for listed, unit in items:
            if "(" in unit or "[" in unit:
                unit = _REFERENCE.sub("", unit)
            if "`" in unit:
                unit = _INLINE.sub(" ", unit)
            if "://" in unit or "www." in unit or "@" in unit:
                unit = _LINK.sub(" ", unit)
            unit = unit.strip()
            if not unit:
                continue
            if single and not re.search(r"[.!?:;,…]['\")\]]*$", unit) and len(unit.split()) <= 8:
                continue  # a title line
            units.append(unit)
        block.clear()

    items_list = [False]
    for line in _PREFIX.sub("", (text or "").replace("\r\n", "\n").replace("\r", "\n")).split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark.group(1)[0] == fence:
                fence = ""
            continue
        if mark:
            flush()
            fence = mark.group(1)[0]
            continue
        bare = line.strip()
        if not bare:
            flush()
            continue
        if line[0] == ">":
            line = line.lstrip("> ")
            bare = line.strip()
        if line[0].isalpha():  # most lines: only what can begin with a letter
            odd = _WORDY.match(line) or (("|" in line or "\t" in line) and _TABLE.search(line))
        else:
            odd = _HEADING.match(line) or _RULE.match(line) or _TABLE.search(line) or _LOG.match(line) or _TRACE.match(line) or _DATA.match(line)
            odd = odd or ((line[:4] == "    " or line[0] == "\t") and not _LIST.match(line) and not (block and _LIST.match(block[0])))
        if odd or (bare[-1] in ";{}" and _CODE.search(line) and not re.search(r"[a-z] [a-z]+ [a-z]+ ", line)) or (" " not in bare and _LINK.match(bare)):
            flush()
            continue
        block.append(line)
    flush()
    return units


def measure(text: str | None, rank: Callable[[str], int]) -> tuple[bool, int, int, int, int | None]:
    """(english, words, sentences, syllables, coverage rank) of the prose; without words the rank is null."""
    words: Counter[str] = Counter()
    sentences = 0
    for unit in prose_units(text):
        found = _WORD.findall(unit.lower())
        if not found:
            continue
        words.update(found)
        ends = len(_END.findall(unit))
        sentences += ends + (0 if ends and _END.search(unit[-3:] + " ") else 1)
    for w in [w for w in words if w[0].isdigit() and w != "0"]:
        words["0"] += words.pop(w)
    n = sum(words.values())
    english = sum(c for w, c in words.items() if w in _ENGLISH)
    german = sum(c for w, c in words.items() if w in _GERMAN)
    covered, reached = 0, None
    for place, count in sorted((rank(w), c) for w, c in words.items()):
        covered, reached = covered + count, place
        if covered >= COVERED * n:
            break
    return english > german and english * 20 >= n, n, sentences, sum(syllables(w) * c for w, c in words.items()), reached


MEASURED = "id long, english boolean, words long, sentences long, syllables long, rank long"


def measured(texts: DataFrame, key: str, vocabulary: str | None = None) -> DataFrame:
    """Rows of ``MEASURED`` for each row of (key, text); null and empty texts have no words. vocabulary: path of its file."""
    columns, where = [c.split()[0] for c in MEASURED.split(", ")], vocabulary or tokens.words_path()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = tokens.word_ranks(where)
        for part in parts:
            rows = [(i, *measure(t, rank)) for i, t in part[["id", "text"]].itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=columns).astype({"id": "Int64", "rank": "Int64"})

    return spread(texts.select(F.col(key).alias("id"), "text")).mapInPandas(run, MEASURED)


#: Traits of the scale, and of the one that checks what lies close to a cut.
TRAITS = {"x0": "1.0", "x1": "words / sentences", "x2": "ln(rank)"}
CHECKED = TRAITS | {"x3": "syllables / words"}


def calibrate(samples: DataFrame, traits: dict[str, str]) -> tuple[list[float], list[int], list[float]]:
    """Weights of the traits, the bands in order and the cuts between them, from (band, words, sentences, syllables, rank).

    The sums of products of a least-squares fit of the band on the traits, and the extremes of each band on the fitted
    scale, are SQL aggregates over the sample texts; a cut lies midway between the extremes of neighbouring bands.
    """
    rows = samples.selectExpr("band", *[f"{x} AS {k}" for k, x in traits.items()])
    names = list(traits)
    sums = rows.selectExpr(*[f"sum({a} * {b}) AS {a}{b}" for a in names for b in names], *[f"sum({a} * band) AS {a}y" for a in names]).first()
    if sums is None or sums["x0x0"] is None:
        return [], [], []
    left = np.array([[sums[a + b] for b in names] for a in names], dtype=float)
    weights = np.linalg.lstsq(left, np.array([sums[a + "y"] for a in names], dtype=float), rcond=None)[0].tolist()
    ends = rows.selectExpr("band", f"{_scale(weights, names)} AS s").groupBy("band").agg(F.min("s").alias("low"), F.max("s").alias("high")).orderBy("band").collect()
    return weights, [r["band"] for r in ends], [(a["high"] + b["low"]) / 2 for a, b in zip(ends, ends[1:])]


def _scale(weights: list[float], names: list[str]) -> str:
    return " + ".join(f"{w!r}D * {a}" for w, a in zip(weights, names))


def _band(s: str, bands: list[int], cuts: list[float]) -> Column:
    band = F.lit(bands[0])
    for cut_at, name in zip(cuts, bands[1:]):
        band = F.when(F.col(s) > cut_at, F.lit(name)).otherwise(band)
    return band.cast("int")


def levels(documents: DataFrame, samples: DataFrame, key: str = "doc_id", sample_key: str = "anchor_id", vocabulary: str | None = None) -> DataFrame:
    """(key, band, words, coverage_rank, words_per_sentence, syllables_per_word, checked) of English documents with enough prose.

    Repeated rows come out repeatedly; null and empty texts, other languages and documents with fewer than
    ``LEAST_WORDS`` words of prose do not come out. Without sample texts there are no bands and no rows. ``checked`` tells
    that the document lies within ``CLOSE`` of a cut and has its band from the second scale.
    """
    samples = samples.select(F.col(sample_key).alias("id"), "band", "text")
    anchors = cut(measured(samples, "id", vocabulary).where("words >= 1 AND sentences >= 1").join(samples.select("id", "band"), "id"))
    weights, bands, cuts = calibrate(anchors, TRAITS)
    if not bands:
        none = (("band", "int"), ("words", "long"), ("coverage_rank", "long"), ("words_per_sentence", "double"), ("syllables_per_word", "double"), ("checked", "boolean"))
        return documents.limit(0).select(key, *[F.lit(None).cast(t).alias(c) for c, t in none])
    more, _, finer = calibrate(anchors, CHECKED)
    rows = measured(documents, key, vocabulary).where(f"english AND sentences >= 1 AND words >= {LEAST_WORDS}")
    rows = rows.selectExpr("id", "words", "rank", *[f"{x} AS {k}" for k, x in CHECKED.items()])
    rows = rows.selectExpr("*", f"{_scale(weights, list(TRAITS))} AS s", f"{_scale(more, list(CHECKED))} AS finer")
    distance = F.least(*[F.abs(F.col("s") - c) for c in cuts]) if len(cuts) > 1 else F.abs(F.col("s") - cuts[0]) if cuts else F.lit(None).cast("double")
    checked = F.coalesce(distance < CLOSE, F.lit(False))
    band = F.when(checked, _band("finer", bands, finer)).otherwise(_band("s", bands, cuts))
    return rows.select(F.col("id").alias(key), band.alias("band"), "words", F.col("rank").alias("coverage_rank"), F.col("x1").alias("words_per_sentence"), F.col("x3").alias("syllables_per_word"), checked.alias("checked"))
