"""Resolution of callee texts to function nodes.

A cascade of rules, the first match winning, becomes one equi-join: every key of the symbol table is exploded into the
texts that a rule would accept for it (itself, its proper suffixes, what follows an underscore or dollar in its last part),
and the least (rule, order of the key) wins. No scan of the symbol table for each call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEAST_FUZZY = 4
#: Most hash values of pieces that are sent to all tasks.
MARKS = 1 << 18
SEPARATORS = {"java": ".", "javascript": ".", "cpp": "::"}


def symbols(definitions: DataFrame) -> DataFrame:
    """(key, node_id, key_ord) from (key, node_id, ord): a key keeps its first place and its last value."""
    return definitions.groupBy("key").agg(F.min("ord").alias("key_ord"), F.max_by("node_id", "ord").alias("node_id"))


def _suffixes(key: Column, sep: str) -> Column:
    """Proper suffixes of the key that follow a separator."""
    parts = F.split(key, sep.replace(".", r"\."))
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n), sep))).otherwise(F.array().cast("array<string>"))


def _tails(key: Column, sep: str, marks: str) -> Column:
    """The last part of the key, and what follows each mark in it."""
    last = F.element_at(F.split(key, sep.replace(".", r"\.")), -1)
    pieces = F.array(last)
    for mark in marks:
        pieces = F.concat(pieces, _after(F.split(last, r"\$" if mark == "$" else mark), mark))
    return F.array_distinct(pieces)


def _after(parts: Column, mark: str) -> Column:
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n), mark))).otherwise(F.array().cast("array<string>"))


def resolve(call_facts: DataFrame, symbol: DataFrame, language: str) -> DataFrame:
    """(caller_key, callee, node_id, rule) for (caller_key, callee) rows of one language; what matches nothing is left out.

    Rules: 1 the caller's class and the callee, 2 its enclosing scope (C++, JavaScript) or simple class (Java), 3 the first
    key that ends with the callee (JavaScript: or equals it), 4 for callees of four characters or more the first key whose
    last part is the callee or ends with it after an underscore (Java: or dollar). JavaScript callees with a dot that are
    keys themselves come first, as rule 0.
    """
    sep = SEPARATORS[language]
    facts = call_facts.select("caller_key", "callee").distinct()
    parts = F.split("caller_key", sep.replace(".", r"\."))
    n = F.size(parts)
    head = F.when(n > 1, F.array_join(F.slice(parts, 1, n - 1), sep)).otherwise("")
    simple = F.when(n > 1, F.element_at(parts, -2)).otherwise("")
    outer = F.when(n > 2, F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), sep)).otherwise("")
    join = lambda a: F.when(a != "", F.concat(a, F.lit(sep), F.col("callee")))
    if language == "java":
        exact = [(1, F.when(F.contains(head, F.lit(".")), join(head))), (2, join(simple))]
    elif language == "cpp":
        exact = [(1, join(simple)), (2, join(outer))]
    else:
        exact = [(0, F.when(F.contains("callee", F.lit(".")) & (simple != ""), F.col("callee"))), (1, join(simple)), (2, join(outer))]
    wanted = [F.struct(F.lit(r).alias("rule"), c.alias("text")) for r, c in exact]
    wanted.append(F.struct(F.lit(3).alias("rule"), F.col("callee").alias("text")))
    wanted.append(F.struct(F.lit(4).alias("rule"), F.when(F.length("callee") >= LEAST_FUZZY, F.col("callee")).alias("text")))
    asked = facts.select("caller_key", "callee", F.explode(F.array(*wanted)).alias("w")).select("caller_key", "callee", "w.rule", F.col("w.text").alias("text")).where("text is not null")
    key = F.col("key")
    whole = F.transform(F.array(key), lambda t: F.struct(F.lit(0).alias("kind"), t.alias("text")))
    ends = F.concat(_suffixes(key, sep), F.array(key)) if language == "javascript" else _suffixes(key, sep)
    ends = F.transform(F.array_distinct(ends), lambda t: F.struct(F.lit(3).alias("kind"), t.alias("text")))
    tails = F.transform(_tails(key, sep, "_$" if language == "java" else "_"), lambda t: F.struct(F.lit(4).alias("kind"), t.alias("text")))
    offered = symbol.select("node_id", "key_ord", F.explode(F.concat(whole, ends, tails)).alias("o")).select("node_id", "key_ord", F.col("o.kind").alias("kind"), F.col("o.text").alias("text"))
    # of all keys that offer the same text only the first can win
    first = offered.groupBy("kind", "text").agg(F.min(F.struct("key_ord", "node_id")).alias("best"))
    asked = asked.withColumn("kind", F.when(F.col("rule") < 3, 0).otherwise(F.col("rule")))
    matched = asked.join(first, ["kind", "text"])
    return matched.groupBy("caller_key", "callee").agg(F.min(F.struct("rule", "best")).alias("m")).select("caller_key", "callee", F.col("m.best.node_id").alias("node_id"), F.col("m.rule").alias("rule"))


def contains_match(call_facts: DataFrame, symbol: DataFrame, gram: int = 4) -> DataFrame:
    """(callee, node_id): the first key that contains the callee, of whatever length; empty callees name nothing and match none.

    Keys and callees share every piece of ``gram`` characters of the callee; they are joined on the one that the fewest keys
    have, so that a common beginning does not bring all its keys together. A shorter callee equals one of the pieces of its
    own length, of which only the first key that holds it can win.

    Joins of pieces are sort-merge joins: the planner doesn't count how many pieces a text is cut into, and would send them
    to all tasks through the driver. Sent are only the hash values, MARKS at most, of the pieces joined on, so that few of the
    other pieces are exchanged.
    """
    callees = call_facts.select("callee").distinct()
    cut_up = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.col(c).substr(i, F.lit(n)))
    pieces = lambda n: cut_up("key", n)
    offered = symbol.select("key", "node_id", "key_ord", F.explode(F.array_distinct(pieces(gram))).alias("piece"))
    common = offered.groupBy("piece").agg(F.count(F.lit(1)).alias("keys"))
    whole = callees.where(F.length("callee") >= gram).select("callee", F.explode(F.array_distinct(cut_up("callee", gram))).alias("piece"))
    asked = whole.join(common.hint("merge"), "piece").groupBy("callee").agg(F.min_by("piece", F.struct("keys", "piece")).alias("piece"))
    mark = F.pmod(F.hash("piece"), F.lit(MARKS))
    marks = asked.select(mark.alias("mark")).distinct()
    offered = offered.withColumn("mark", mark).join(F.broadcast(marks), "mark", "left_semi").drop("mark")
    found = asked.join(offered.hint("merge"), "piece").where(F.contains("key", "callee")).groupBy("callee").agg(F.min_by("node_id", "key_ord").alias("node_id"))
    if gram < 2:
        return found
    short = symbol.select("node_id", "key_ord", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in range(1, gram)]))).alias("callee"))
    first = short.where("callee <> ''").groupBy("callee").agg(F.min_by("node_id", "key_ord").alias("node_id"))
    return found.unionByName(callees.where(F.length("callee") < gram).join(first.hint("merge"), "callee"))


def call_edges(resolved: DataFrame, symbol: DataFrame) -> DataFrame:
    """(source_id, target_id): distinct call edges from resolved facts, callers by their key."""
    callers = symbol.select(F.col("key").alias("caller_key"), F.col("node_id").alias("source_id"))
    return resolved.join(callers, "caller_key").select("source_id", F.col("node_id").alias("target_id")).distinct()
