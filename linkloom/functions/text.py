"""String operators on columns: identifiers, summaries, requirement texts and replies of a judge. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values.
IGNORED_DIRS = ("build", "cmake-build", ".git", "vendor", "lib", "external", "Debug", "__pycache__", ".pytest_cache", "target", ".idea", ".vscode", "node_modules")
LANGUAGES = {
    "cpp": (".c", ".cpp", ".h", ".hpp", ".tcc"),
    "java": (".java",),
    "javascript": (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"),
}
STOP_WORDS = tuple("the is at which on and to of in for a an be by from or as with it this that c cpp java void int char return".split())
SUMMARY_PREFIXES = ("This function", "This method", "The function", "The method", "Function to", "Method to", "This procedure", "This routine")
UTILITY_VERBS = ("get", "set", "is", "has", "check", "validate", "create", "delete", "update", "find", "search")
KEPT_WORDS, CHAIN_LIMIT, LEAST_SUMMARY, LEAST_PART = 8, 300, 10, 3
CHUNK_SIZE, CHUNK_OVERLAP = 600, 50
ARROW = " → "
SCORE_LABELS = (
    ("Overall Score", "overall"), ("Semantic Relevance", "semantic"), ("Logical Completeness", "completeness"), ("Dataflow Continuity", "dataflow"),
    ("Call Rationality", "rationality"), ("Functional Completeness", "completeness"), ("Logical Coherence", "completeness"),
    ("Implementation Efficiency", "rationality"), ("Extensibility", "semantic"),
)
REASON_LABELS = ("Judgment Reason", "Reason", "Analysis Conclusion")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_func_id(c: Column) -> Column:
    """The id without its kind: where it starts with ``Function:`` (else ``Method:``), every occurrence of that is removed; null becomes empty."""
    return F.when(c.startswith("Function:"), F.replace(c, F.lit("Function:"), F.lit(""))).when(c.startswith("Method:"), F.replace(c, F.lit("Method:"), F.lit(""))).otherwise(F.coalesce(c, F.lit("")))


def detect_language(path: Column) -> Column:
    """Language of the last suffix of the file name, in lower case; null for others."""
    suffix = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    out = F.lit(None).cast("string")
    for language, suffixes in LANGUAGES.items():
        out = F.when(suffix.isin(*suffixes), language).otherwise(out)
    return out


def in_ignored_dir(path: Column) -> Column:
    """Whether a directory of the path (not its first, the root's own name, nor the file) has an ignored name."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x.isin(*IGNORED_DIRS))


def keywords(c: Column) -> Column:
    """Sorted distinct words of more than one character that are no stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))))


def keyword_union(*texts: Column) -> Column:
    """Sorted distinct keywords of several texts; null texts have none."""
    lists = [F.coalesce(keywords(c), F.array().cast("array<string>")) for c in texts]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*lists))))


def concise(c: Column) -> Column:
    """A summary without its stock beginning, cut to its first words, without blanks, dots and commas at the ends."""
    text = F.regexp_replace(strip(c), r"(?iU)^(?:" + "|".join(SUMMARY_PREFIXES) + r")\s*", "")
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    cut = F.when(F.contains(text, F.lit(" ")) & (F.size(words) > KEPT_WORDS), F.concat(F.array_join(F.slice(words, 1, KEPT_WORDS), " "), F.lit("..."))).otherwise(text)
    return F.btrim(cut, F.lit(" .,"))


def is_utility(c: Column) -> Column:
    return F.lower(c).rlike("^(" + "|".join(UTILITY_VERBS) + ") ")


def paragraphs(c: Column) -> Column:
    """Non-empty paragraphs, between lines that are blank in the Unicode sense, without white space at the ends."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda p: p != "")


def word_windows(c: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of size // 5 words, each starting overlap // 5 words before the end of the one before; no words give none."""
    width, stride = size // 5, size // 5 - overlap // 5
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(stride))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, width), " ")))


def chunks(c: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Paragraphs packed greedily: joined by a blank, which is not counted, while their lengths stay within ``size``; longer
    paragraphs become word windows of their own. Null and blank texts give no chunks."""

    def step(acc: Column, para: Column) -> Column:
        current, done = acc["current"], acc["done"]
        over = F.length(current) + F.length(para) > size
        flushed = F.when(current != "", F.concat(done, F.array(current))).otherwise(done)
        long = F.length(para) > size
        return F.struct(
            F.when(over & long, F.concat(flushed, word_windows(para, size, overlap))).when(over, flushed).otherwise(done).alias("done"),
            F.when(over & long, F.lit("")).when(over | (current == ""), para).otherwise(F.concat(current, F.lit(" "), para)).alias("current"),
        )

    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"))
    packed = F.aggregate(paragraphs(F.coalesce(c, F.lit(""))), empty, step)
    return F.when(packed["current"] != "", F.concat(packed["done"], F.array(packed["current"]))).otherwise(packed["done"])


def template_summary(name: Column, language: Column, signature: Column, snippet: Column) -> Column:
    """Summary without a model, from name, language, first line of code and signature; an empty snippet says so."""
    first = F.left(F.split(strip(snippet), "\n")[0], F.lit(120))
    lines = F.concat_ws("\n", F.concat(F.lit("Name: "), name), F.concat(F.lit("Language: "), language), F.concat(F.lit("First line: "), first), F.concat(F.lit("Signature: "), signature), F.lit("Written without a model."))
    return F.when(F.coalesce(strip(snippet), F.lit("")) == "", F.lit("No code to describe.")).otherwise(lines)


def parse_reply(c: Column) -> Column:
    """Scores and reason of a judge's reply, a struct; null for an empty reply.

    Labels are read in a fixed order and a later one overwrites the slot it shares with an earlier one. Only forms like
    0.5 or 0.55 count. A missing (or exactly 0.5) overall score becomes the mean of the four dimensions where one differs
    from 0.5. The reason ends at a blank line or a line that begins with a capital.
    """
    slots: dict[str, Column] = {}
    for label, slot in SCORE_LABELS:
        text = F.regexp_extract(c, label + r"(?U)\s*[:：]\s*([0-9]\.[0-9]{1,2})", 1)
        value = F.least(F.lit(1.0), F.when(text != "", text.cast("double")))
        value = F.when(text != "", F.greatest(F.lit(0.0), value))
        slots[slot] = F.coalesce(value, slots[slot]) if slot in slots else value
    scores = {k: F.coalesce(v, F.lit(0.5)) for k, v in slots.items()}
    dims = [scores[k] for k in ("semantic", "completeness", "dataflow", "rationality")]
    mean = sum(dims[1:], dims[0]) / 4
    differs = (dims[0] != 0.5) | (dims[1] != 0.5) | (dims[2] != 0.5) | (dims[3] != 0.5)
    overall = F.when((scores["overall"] == 0.5) & differs, mean).otherwise(scores["overall"])
    reason = F.lit("No detailed reasoning")
    for label in reversed(REASON_LABELS):
        found = F.regexp_extract(c, r"(?sU)" + label + r"\s*[:：]\s*(.+?)(?:\n\n|\n[A-Z]|\n?\z)", 1)
        reason = F.when(found != "", strip(F.regexp_replace(found, r"(?U)\s+", " "))).otherwise(reason)
    parsed = F.struct(
        overall.alias("overall"), dims[0].alias("semantic"), dims[1].alias("completeness"), dims[2].alias("dataflow"), dims[3].alias("rationality"), F.lit(0.1).alias("uncertainty"), reason.alias("reason")
    )
    return F.when(F.coalesce(c, F.lit("")) != "", parsed)


def neutral_scores(reason: str = "No judgment available") -> Column:
    """What stands in for a judge that gives nothing."""
    half = [F.lit(0.5).alias(k) for k in ("overall", "semantic", "completeness", "dataflow", "rationality")]
    return F.struct(*half, F.lit(0.3).alias("uncertainty"), F.lit(reason).alias("reason"))
