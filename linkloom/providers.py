"""Models outside this library: summaries, embeddings, judgments. The offline defaults need none and are deterministic."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .functions import text


PROMPT_NODES, PROMPT_DETAIL = 4, 100  # key nodes in a prompt, characters of each


def _with(df: DataFrame, name: str) -> StructType:
    return StructType([*df.schema.fields, StructField(name, StringType())])


def summarize(functions: DataFrame, model: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """``functions`` (id, name, language, signature, code) with ``summary``: from a model called batch by batch, or the template."""
    if model is None:
        return functions.withColumn("summary", text.template_summary(F.col("name"), F.col("language"), F.col("signature"), F.col("code")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                yield part.assign(summary=model(part))
            except Exception as e:  # noqa: BLE001 a failed call becomes a text, as a failed job would repeat all calls
                yield part.assign(summary=f"Summary failed: {e}")

    return functions.mapInPandas(run, _with(functions, "summary"))


def hashed_words(texts: pd.Series, width: int) -> list[list[float]]:
    """Vectors of texts without a model: each word of two characters or more adds 1 or -1 at a place, both from its checksum."""
    out = []
    for text in texts:
        vector = [0.0] * width
        for word in set(re.findall(r"\w\w+", (text or "").lower())):
            code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            vector[(code >> 1) % width] += 1.0 if code & 1 else -1.0
        out.append(vector)
    return out


def embed(rows: DataFrame, column: str, width: int, model: Callable[[pd.Series], list] | None = None) -> DataFrame:
    """``rows`` with ``embedding``: each distinct text is embedded once, then joined back. Null texts, vectors of another width
    and failures of the model give a vector of zeros; offline the words are hashed."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    model = model or partial(hashed_words, width=width)

    @F.pandas_udf("array<float>")
    def call(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series([v if v is not None and len(v) == width else [0.0] * width for v in model(texts)])
        except Exception:  # noqa: BLE001
            return pd.Series([[0.0] * width] * len(texts))

    known = rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn("embedding", call(F.col(column)))
    return rows.join(known, column, "left").withColumn("embedding", F.coalesce("embedding", zero))


def prompt(requirement: Column, summary: Column, details: Column) -> Column:
    """What a judge is asked about a chain: the requirement, the chain's summary, four key nodes with up to 100 characters
    of detail each, and the labels under which ``text.parse_reply`` reads the answer."""
    nodes = F.array_join(F.transform(F.slice(details, 1, PROMPT_NODES), lambda x: F.concat(F.lit("* "), F.left(x, F.lit(PROMPT_DETAIL)))), "\n")
    labels = "\n".join(f"{label}: 0.00" for label, _ in text.SCORE_LABELS[:5]) + f"\n{text.REASON_LABELS[0]}: ..."
    return F.concat_ws(
        "\n\n", F.concat(F.lit("Does this chain of calls carry out the requirement?\nRequirement: "), requirement), F.concat(F.lit("Chain: "), summary),
        F.when(nodes != "", F.concat(F.lit("Its main functions:\n"), nodes)), F.lit("Answer with numbers from 0 to 1, one a line:\n" + labels),
    )


def judge(chains: DataFrame, model: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """``chains`` with ``scores``, read from a model's replies; without a model, and for empty replies, the neutral scores."""
    if model is None:
        return chains.withColumn("scores", text.neutral_scores())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                yield part.assign(reply=model(part))
            except Exception:  # noqa: BLE001
                yield part.assign(reply="")

    replied = chains.mapInPandas(run, _with(chains, "reply"))
    return replied.withColumn("scores", F.coalesce(text.parse_reply(F.col("reply")), text.neutral_scores()))
