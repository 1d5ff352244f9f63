"""What answers would be on other evidence: on the gold passages, on those of a saved run; and how two runs' answers differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from evispark.operators import answering, loop, routing


def on_gold(items: DataFrame, chunks: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """answers() of each question (query_id, query, relevant_chunk_ids) from its gold passages, in their order, each of score 1.

    Repeated ids count once, at their first place; ids without a chunk are left out; a question without any is refused.
    """
    routed = routing.route(items.select("query_id", "query"), corpus if corpus is not None else routing.scope(chunks))
    gold = items.select("query_id", F.posexplode(F.array_distinct("relevant_chunk_ids")).alias("at", "chunk_id")).join(chunks, "chunk_id")
    hits = gold.withColumns({"rank": F.col("at") + 1, "score": F.lit(1.0), "source": F.lit("gold_evidence")}).select("query_id", *loop.HIT, "rank")
    return answering.answers(routed, answering.evidence(routed, hits))


def losses(items: DataFrame, gold_answers: DataFrame, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each question (query_id, expected, relevant_chunk_ids) with what its gold passages and the path gave, and where a wrong answer was lost.

    loss: `none` if the path's answer is the expected one; else `routing` if the route refused it, `extraction` if the
    gold passages don't give it either, `retrieval` if not all of them are in the path's evidence (query_id, chunk_id), else
    `selection`: what was needed was there, and another passage's value was taken. A question the path has no answer for is lost like a wrong one.
    """
    same = lambda c: F.col(c).eqNullSafe(F.col("expected"))
    found = evidence.groupBy("query_id").agg(F.collect_set(F.col("chunk_id").cast("string")).alias("__found"))
    rows = items.join(gold_answers.select("query_id", F.col("answer").alias("__gold"), F.col("status").alias("oracle_status"), "should_refuse"), "query_id")
    rows = rows.join(answers.select("query_id", F.col("answer").alias("__path"), F.lit(True).alias("__there")), "query_id", "left").join(found, "query_id", "left")
    missing = F.size(F.array_except(F.transform("relevant_chunk_ids", lambda c: c.cast("string")), F.coalesce("__found", F.array().cast("array<string>")))) > 0
    right = same("__path") & F.col("__there").isNotNull()
    loss = F.when(right, "none").when(F.col("should_refuse"), "routing").when(~same("__gold"), "extraction").when(missing, "retrieval").otherwise("selection")
    return rows.select("query_id", "oracle_status", same("__gold").alias("oracle_exact"), right.alias("path_exact"), loss.alias("loss"))


def summary(found: DataFrame) -> DataFrame:
    """One row: how many questions, which share the gold passages answer and answer exactly, and the questions lost at each stage."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    lost = [F.count_if(F.col("loss") == x).alias(f"lost_{x}") for x in ("routing", "extraction", "retrieval", "selection")]
    return found.agg(F.count("*").alias("questions"), share(F.col("oracle_status") == "answered").alias("answer_rate"), share(F.col("oracle_exact")).alias("exact_answer_accuracy"), share(F.col("path_exact")).alias("path_accuracy"), *lost)


def answered_again(trajectories: DataFrame, items: DataFrame, chunks: DataFrame, minimum: float = 0.0, corpus: DataFrame | None = None) -> DataFrame:
    """answers() of the questions (query_id, query) of saved trajectories, from the passages they ended with: nothing is searched or ranked again."""
    routed = routing.route(items.select("query_id", "query").join(trajectories.select("query_id").distinct(), "query_id"), corpus if corpus is not None else routing.scope(chunks))
    return answering.answers(routed, answering.evidence(routed, loop.reconstruct(trajectories, chunks), minimum))


def leaves(value: Column, kind: DataType, path: Column, ids: Sequence[str] = ("chunk_id",)) -> Column:
    """A value's leaves that aren't null, as (path, value): of a struct by field, of an array by place, or by the first of `ids` that its structs have."""
    none = F.array().cast("array<struct<path: string, value: string>>")
    if isinstance(kind, StructType):
        parts = [leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), ids) for f in kind]
        return F.when(value.isNull(), none).otherwise(F.concat(*parts)) if parts else none
    if isinstance(kind, MapType):
        entries = ArrayType(StructType().add("key", kind.keyType).add("value", kind.valueType))
        return leaves(F.map_entries(value), entries, path, ("key",))
    if isinstance(kind, ArrayType):
        own = next((i for i in ids if isinstance(kind.elementType, StructType) and i in kind.elementType.names), None)
        name = (lambda x, i: F.coalesce(x[own].cast("string"), F.lit("null"))) if own else (lambda x, i: i.cast("string"))
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: leaves(x, kind.elementType, F.concat(path, F.lit("["), name(x, i), F.lit("]")), ids))), none)
    return F.when(value.isNull(), none).otherwise(F.array(F.struct(path.alias("path"), value.cast("string").alias("value"))))


def differences(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str], ids: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """(keys, path, change, before, after): the leaves of the fields that two runs' rows with equal keys have otherwise, one row a leaf.

    change: `added`, `removed` or `changed`. Null and absent are the same; so are equal values whatever the order of
    structs that have an id. A row that one run lacks has all its leaves added or removed. Keys compare null-safely; where a
    key or an id repeats, its leaves are compared in the order of their values.
    """

    def flat(rows: DataFrame, name: str) -> DataFrame:
        each = F.concat(*(leaves(F.col(f), rows.schema[f].dataType, F.lit(f), ids) for f in fields))
        told = rows.select(*keys, F.explode(each).alias("l")).select(*keys, "l.path", "l.value")
        values = told.groupBy(*keys, "path").agg(F.array_sort(F.collect_list("value")).alias("v"))
        return values.select(*keys, "path", F.posexplode("v").alias("turn", name))

    a, b = flat(before, "before").alias("a"), flat(after, "after").alias("b")
    same = F.lit(True)
    for c in (*keys, "path", "turn"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = a.join(b, same, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.select(*(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in (*keys, "path")), change.alias("change"), "before", "after")
