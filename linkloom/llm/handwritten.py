"""Generated, minified, third-party and data-payload source files, told by their identifiers.

One pass lexes every file into a small feature row; a second adds up identifier character trigrams to one model per
language (at most 3 x 32,768 counts, the only thing broadcast); a third scores each file under its language's model. Then:

* *minified*: the model finds the names mangled (high cross-entropy a character) and nearly all are a few characters long;
* *generated*: template-like names of low diversity, measured by the entropy of the words that the names are made of over
  what a file of as many tokens could have; the stranger the model finds the names, the sooner. Beside it count the few
  markers that generators agreed on;
* *vendored*: a naming style foreign to the repository's files of the language, or what names cannot show: a notice of
  another owner above the code, a directory named after a known outside package, the same code in several repositories;
* *data*: literals make up most of the code.

A notice speaks of another owner only where it is rare. The notice that heads a good part of all files with one, or of its
repository's files, is the house's own, whatever its words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..parse import lexer as L
from ..runtime import keep, spread

#: Parameters with their meanings.
DATA_SHARE = 0.45  # of the characters of code, in literals
LEAST_TOKENS = 100  # of code, below which the diversity of names tells nothing
TEMPLATE_DIVERSITY = 0.3  # of names, below which they come from a template
STRANGE_GAIN = 0.8  # by which that bound rises with each bit of cross-entropy a character above the language's mean file
MOST_DIVERSITY = 0.52  # beyond which the bound does not rise
MANGLED_BITS = 1.0  # of cross-entropy a character above the language's mean file, from which names are mangled
MANY_NAMES = 8  # names that a file must have to be minified
BRIEF_NAMES = 0.6  # share of names of three characters or less in a minified file
ALL_BRIEF = 0.85  # the same from which the model is not asked, as a language with few files has trained it on this one
MIN_PRINT = 40  # tokens that a file must have to count as copied
STYLED_NAMES = 10  # names that a file must have to show a style
FOREIGN_STYLE = 0.6  # distance between the style of its names and the repository's, 0 to 1
HOUSE_SHARE, HOUSE_FILES = 0.2, 4  # share and number of files with a notice, from which a notice is the house's own

#: Words of a notice of ownership.
_OWNER = re.compile(r"SPDX-License-Identifier|\blicen[cs]ed?\b|\bimported from\b|in sync with upstream|\bcopyright\b|\(c\)\s*\w|©|\|\s*(?:MIT|BSD|Apache|GPL|zlib|ISC)\b", re.I)
#: Markers that generators agreed on, which begin their line of a comment.
_MARKER = re.compile(r"^\W*(?:@generated\b|<auto-generated\b|Code generated\b.*\bDO NOT EDIT\b)")
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
_KEYWORDS = frozenset(
    "abstract auto async await bool boolean break byte case catch char class const constexpr continue default delete do double else enum explicit export extends extern false final finally float for from "
    "function get goto if implements import in inline instanceof int interface let long namespace new noexcept null nullptr of operator override package private protected public return set short "
    "signed sizeof static struct super switch synchronized template this throw throws true try typedef typename typeof undefined unsigned using var virtual void volatile while yield include pragma once define".split()
)

STYLES = ("snake", "camel", "pascal", "upper")
FEATURES = (
    "path string, repo string, language string, marker boolean, notices array<string>, dirs array<string>, print string, literal double, tokens int, diversity double, names int, brief double, "
    + ", ".join(f"{s} double" for s in STYLES) + ", grams array<int>, counts array<int>"
)
COLUMNS = [c.split()[0] for c in FEATURES.split(", ")]


def _codes() -> np.ndarray:
    """Character class of each code point below 128: 1-26 letters, 27 digits, 28 underscore, 29 dollar, 31 others."""
    t = np.full(129, 31)
    for i in range(26):
        t[ord("a") + i] = t[ord("A") + i] = i + 1
    t[ord("0") : ord("9") + 1] = 27
    t[ord("_")], t[ord("$")] = 28, 29
    return t


_CODE = _codes()
_EDGE = 0


def _trigrams(names: set[str]) -> tuple[list[int], list[int]]:
    """Distinct trigrams of the names with edges, as 15-bit numbers, and their counts."""
    if not names:
        return [], []
    text = "\x00\x00" + "\x00\x00".join(sorted(names)) + "\x00"
    raw = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 128).astype(np.int64)
    codes = np.where(raw == 0, _EDGE, _CODE[raw])
    grams = codes[:-2] << 10 | codes[1:-1] << 5 | codes[2:]
    grams = grams[codes[1:-1] + codes[2:] > 0]  # none lies across two names
    counts = np.bincount(grams, minlength=1 << 15)
    keys = np.flatnonzero(counts)
    return keys.tolist(), counts[keys].tolist()


def _diversity(names: set[str], tokens: int) -> float:
    """Entropy of the words in the names, numbers alike, over that of as many different words as the file has tokens."""
    pieces = Counter("#" if x[0].isdigit() else x.lower() for x in _PIECES.findall(" ".join(names)))
    n = sum(pieces.values())
    return -sum(c / n * math.log2(c / n) for c in pieces.values()) / math.log2(max(tokens, 2)) if n else 0.0


def _styles(names: set[str]) -> list[float]:
    """Shares of names by ``STYLES``: words joined by underscores, humps after a small or a large first letter, all capitals."""
    n = max(len(names), 1)
    upper = sum(w.isupper() and len(w) > 1 for w in names)
    snake = sum("_" in w.strip("_") and not w.isupper() for w in names)
    pascal = sum(w[0].isupper() and not w.isupper() and "_" not in w for w in names)
    camel = sum(w[0].islower() and not w.islower() and "_" not in w for w in names)
    return [snake / n, camel / n, pascal / n, upper / n]


def _comments(text: str, toks) -> list[str]:
    """Lines of the comments before the first token that is none."""
    lines: list[str] = []
    for k, a, b in toks:
        if k != "c":
            break
        lines += text[a:b].split("\n")
    return lines


def describe(path: str | None, repo: str | None, unit: L.Unit) -> tuple:
    """The feature row of one file."""
    text, toks = unit.plain, unit.tokens
    notice, below = _comments(text, toks), _comments(text, reversed(toks))
    marker = any(_MARKER.match(x) for x in notice + below)
    code = [text[a:b] for k, a, b in toks if k != "c"]
    joined = " ".join(code)
    size = len(joined) - max(len(code) - 1, 0)
    literal = sum([b - a for k, a, b in toks if k == "s" or k == "n"])
    names = {text[a:b] for k, a, b in toks if k == "w"} - _KEYWORDS
    notices = sorted({re.sub(r"\d+", "0", re.sub(r"^\W+|\W+$", "", x)) for x in notice if _OWNER.search(x)}) if code else []
    prints = hashlib.md5(joined.encode("utf-8", "surrogatepass")).hexdigest() if len(code) >= MIN_PRINT else None
    dirs = [re.sub(r"[-_.@]?v?\d+(?:\.\d+)*$", "", x).lower() for x in (path or "").split("/")[1:-1]]
    brief = sum(len(w) <= 3 for w in names) / len(names) if names else 0.0
    grams, counts = _trigrams(names)
    return path, repo, L.language_of(path), marker, notices, dirs, prints, literal / size if size else 0.0, len(code), _diversity(names, len(code)), len(names), brief, *_styles(names), grams, counts


def _describe_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [describe(p, r, L.Unit(L.language_of(p) or "javascript", L.decode(c))) for p, r, c in part[["path", "repo", "content"]].itertuples(index=False, name=None)]
        yield pd.DataFrame(rows, columns=COLUMNS)


def features(files: DataFrame) -> DataFrame:
    """A feature row for each row of files; null paths stay, null contents count as empty."""
    return spread(files.select("path", "repo", "content")).mapInPandas(_describe_all, FEATURES)


def _partial_model(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for part in parts:
        for language, grams, counts in part[["language", "grams", "counts"]].itertuples(index=False, name=None):
            if language is not None and len(grams):
                np.add.at(sums.setdefault(language, np.zeros(1 << 15, dtype=np.int64)), np.asarray(grams), np.asarray(counts))
    for language, total in sums.items():
        keys = np.flatnonzero(total)
        yield pd.DataFrame({"language": language, "gram": keys.astype("int32"), "n": total[keys]})


def models(rows: DataFrame) -> dict[str, np.ndarray]:
    """Per language the surprise in bits of each trigram given its first two characters, from all files.

    What comes to the driver is bounded by 32,768 counts a language.
    """
    partial = rows.select("language", "grams", "counts").mapInPandas(_partial_model, "language string, gram int, n long")
    counts = partial.groupBy("language", "gram").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for language, own in counts.groupby("language"):
        table = np.zeros(1 << 15)
        table[own["gram"].to_numpy()] = own["n"].to_numpy()
        context = table.reshape(-1, 32).sum(1, keepdims=True)
        out[language] = -np.log2((table.reshape(-1, 32) + 0.1) / (context + 3.2)).reshape(-1)
    return out


def score(rows: DataFrame) -> DataFrame:
    """Feature rows with ``surprise``, the cross-entropy of a file's names per character (null without names)."""
    known = rows.sparkSession.sparkContext.broadcast(models(rows))
    schema = ", ".join(x for x in FEATURES.split(", ") if not x.startswith(("grams", "counts"))) + ", surprise double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = []
            for language, grams, counts in part[["language", "grams", "counts"]].itertuples(index=False, name=None):
                model = known.value.get(language)
                if model is None or not len(grams):
                    values.append(None)
                    continue
                g, c = np.asarray(grams), np.asarray(counts)
                values.append(float((model[g] * c).sum() / c.sum()))
            yield part.drop(columns=["grams", "counts"]).assign(surprise=pd.Series(values, index=part.index, dtype="float64"))

    return rows.select(*COLUMNS).mapInPandas(run, schema)


def _foreign_notices(rows: DataFrame) -> DataFrame:
    """(path): files with a notice that is not the house's own, of the whole collection or of its repository."""
    rows = rows.select("path", F.coalesce("repo", F.lit("")).alias("at"), "notices").where(F.size("notices") > 0)
    held = rows.select("path", "at", F.explode("notices").alias("notice")).distinct()
    of_all = rows.agg(F.countDistinct("path")).scalar()
    of_repo = rows.groupBy("at").agg(F.countDistinct("path").alias("of_repo"))
    house = lambda n, of: (F.col(n) >= HOUSE_FILES) & (F.col(n) >= HOUSE_SHARE * of)
    counts = held.groupBy("at", "notice").agg(F.count(F.lit(1)).alias("n"))
    everywhere = counts.groupBy("notice").agg(F.sum("n").alias("n_all")).where(house("n_all", of_all)).select("notice")
    here = counts.join(of_repo, "at").where(house("n", F.col("of_repo"))).select("at", "notice")
    return held.join(everywhere, "notice", "left_anti").join(here, ["at", "notice"], "left_anti").select("path").distinct()


def judged_rows(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """The verdict of ``judged`` from feature rows that are written already."""
    rows = keep(score(rows.where("path is not null")))  # read by several small aggregates, each of a few columns
    usual = rows.where("surprise is not null").groupBy("language").agg(F.avg("surprise").alias("usual"))
    styled = rows.where(F.col("names") >= STYLED_NAMES).groupBy("repo", "language").agg(*[F.avg(s).alias(f"{s}_usual") for s in STYLES])
    copied = rows.where("print is not null").select("print", "repo").distinct().groupBy("print").count().where("count > 1").select("print", F.lit(True).alias("copied"))
    outside = packages.select(F.lower(F.btrim("package_name")).alias("dir")).where("dir <> ''").distinct()
    lies = rows.select("path", F.explode("dirs").alias("dir")).join(outside, "dir", "left_semi").select("path").distinct().withColumn("lies", F.lit(True))
    noted = _foreign_notices(rows).withColumn("noted", F.lit(True))
    every = rows.join(usual, "language", "left").join(styled, ["repo", "language"], "left").join(copied, "print", "left").join(lies, "path", "left").join(noted, "path", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    odd = F.col("surprise") - F.col("usual")
    many = (F.col("names") >= MANY_NAMES) & (F.col("tokens") >= LEAST_TOKENS)
    mangled = many & (((odd > MANGLED_BITS) & (F.col("brief") > BRIEF_NAMES)) | (F.col("brief") > ALL_BRIEF))
    bound = F.least(F.lit(MOST_DIVERSITY), TEMPLATE_DIVERSITY + STRANGE_GAIN * F.greatest(F.coalesce(odd, F.lit(0.0)), F.lit(0.0)))
    template = (F.col("tokens") >= LEAST_TOKENS) & (F.col("diversity") < bound)
    distance = sum((F.abs(F.col(s) - F.col(f"{s}_usual")) for s in STYLES), F.lit(0.0)) / 2
    foreign = (F.col("names") >= STYLED_NAMES) & (distance > FOREIGN_STYLE) & ~mangled & ~template
    return every.groupBy("path").agg(
        F.max("repo").alias("repo"), F.max("language").alias("language"),
        F.max(yes((template & ~mangled & (F.col("literal") < DATA_SHARE)) | F.col("marker"))).alias("generated"), F.max(yes(mangled)).alias("minified"),
        F.max(yes(foreign) | yes(F.col("noted")) | yes(F.col("copied")) | yes(F.col("lies"))).alias("vendored"),
        F.max(yes(F.col("literal") >= DATA_SHARE)).alias("data"),
        *[F.max(yes(c)).alias(name) for name, c in (("by_names", template | mangled), ("by_style", foreign), ("by_notice", F.col("noted")), ("by_copy", F.col("copied")), ("by_place", F.col("lies")))],
    )


def judged(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, repo, language, generated, minified, vendored, data, by_names, by_style, by_notice, by_copy, by_place) of each distinct path.

    ``packages`` has the names of outside packages in its column ``package_name``. Rows without path are left out; a path
    with several contents counts as what any of them is. Empty files are hand-written; an empty table gives no rows.
    """
    return judged_rows(keep(features(files.where("path is not null"))), packages)


UNWANTED = "generated or minified or vendored or data"


def not_handwritten(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path) of the files that nobody wrote by hand here."""
    return judged(files, packages).where(UNWANTED).select("path")
