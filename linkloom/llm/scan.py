"""One pass over source files for all that reads them: faults, features of their names, documented functions.

A file is decoded, preprocessed and lexed once; only what later steps ask for is computed and leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..parse import lexer as L
from ..runtime import keep, spread
from . import docpairs, handwritten, syntax

SCANNED = handwritten.FEATURES + f", fault string, pairs array<{docpairs.FOUND}>"


def scan(files: DataFrame, with_code: bool = False) -> DataFrame:
    """Rows of ``SCANNED`` for each row of (path, repo, content): features, the first fault, and the documented functions.

    ``fault`` is null for valid files and for paths without a suffix of a known language, which have no functions either.
    ``pairs`` is empty where there is a fault. with_code: whether the functions come with signature, text and code.
    """
    columns = [*handwritten.COLUMNS, "fault", "pairs"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, repo, content in part[["path", "repo", "content"]].itertuples(index=False, name=None):
                language = L.language_of(path)
                unit = L.Unit(language or "javascript", L.decode(content))
                bad = syntax.faults(language, unit.text, unit) if syntax.judged_as(path) else []
                pairs = docpairs.found(unit, with_code) if language and not bad else []
                rows.append((*handwritten.describe(path, repo, unit), bad[0] if bad else None, [dict(zip(docpairs.PAIRS, p)) for p in pairs]))
            yield pd.DataFrame(rows, columns=columns)

    return spread(files.select("path", "repo", "content")).mapInPandas(run, SCANNED)


def documented(files: DataFrame, packages: DataFrame, with_code: bool = False) -> DataFrame:
    """(path, func_name, name_line, ...) of the documented functions in files that parse and that people wrote here."""
    rows = keep(scan(files.where("path is not null"), with_code))
    return docpairs.pairs(rows, handwritten.judged_rows(rows, packages).where(handwritten.UNWANTED))
