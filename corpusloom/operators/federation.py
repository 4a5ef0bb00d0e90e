"""Federated search: every source asked for every query in parallel, with retries, a breaker, modes and resumable state.

A source is a Python function (query -> list of results). The pairs of query and source are spread over the cluster and
asked in Arrow batches, so a slow source holds up its own tasks only. Nothing here opens a connection by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.operators import search

RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("query", "source")]
    + [T.StructField("place", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("title", "url", "snippet", "doi", "arxiv_id")]
    + [T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())]
)
#: Sources of the academic mode, in order.
ACADEMIC_SOURCES = ["openalex", "semantic_scholar", "arxiv", "dblp"]


class RateLimited(Exception):
    """A source asks to come back later."""


class Breaker:
    """Sources that failed too often in this process are asked no more."""

    def __init__(self, most: int = 3):
        self.most, self.failed = most, {}

    def open(self, source: str) -> bool:
        return self.failed.get(source, 0) >= self.most

    def note(self, source: str, ok: bool) -> None:
        self.failed[source] = 0 if ok else self.failed.get(source, 0) + 1


def ask(source: Callable[[str], list[dict]], query: str, tries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> tuple[list[dict], str | None, int]:
    """(results, error, attempts): a rate-limited source is asked again after base**k seconds; other errors end at once."""
    for k in range(tries):
        try:
            return source(query), None, k + 1
        except RateLimited as e:
            if k + 1 == tries:
                return [], f"rate limited: {e}", k + 1
            sleep(base**k)
        except Exception as e:
            return [], f"{type(e).__name__}: {e}", k + 1
    return [], "not asked", 0


def fan_out(queries: DataFrame, sources: dict[str, Callable[[str], list[dict]]], tries: int = 3, breaks_after: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """query, source, place, title, url, snippet, doi, arxiv_id, score, error, attempts: the results of all sources.

    ``queries`` needs query; null and blank ones are left out, repeated ones asked once. A source without results gives no
    row, one that fails a row with its error, one that the breaker holds back a row "source disabled".
    """
    spark = queries.sparkSession
    names = spark.createDataFrame([(n,) for n in sources], "source string")
    asked = queries.select("query").filter("trim(query) <> ''").distinct()
    pairs = asked.select("query", F.explode(F.array(*map(F.lit, sources))).alias("source")) if sources else asked.limit(0).join(names)
    kinds, columns = [f.type for f in to_arrow_schema(RESULT)], RESULT.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaker = Breaker(breaks_after)
        for batch in batches:
            rows = []
            for query, name in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if breaker.open(name):
                    rows.append((query, name, 0, None, None, None, None, None, None, "source disabled", 0))
                    continue
                found, error, attempts = ask(sources[name], query, tries, sleep=sleep)
                breaker.note(name, error is None)
                if error:
                    rows.append((query, name, 0, None, None, None, None, None, None, error, attempts))
                rows += [(query, name, i, r.get("title"), r.get("url"), r.get("snippet"), r.get("doi"), r.get("arxiv_id"), float(r.get("score", 1.0)), None, attempts) for i, r in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    return pairs.repartition(F.col("source"), F.col("query")).mapInArrow(run, RESULT)


def answers(results: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """The k best merged results of every query."""
    from pyspark.sql import Window

    key = search.dedup_key(F.col("doi"), F.col("arxiv_id"), F.col("url"), F.col("title"), F.col("source"))
    keyed = results.withColumn("key", F.concat_ws("\x01", "query", key)).drop("attempts")
    best = search.merged(keyed, weights)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("key", F.expr("substring(key, length(query) + 2)"))


def academic(sources: dict[str, Callable]) -> dict[str, Callable]:
    """The sources of the academic mode, in their order."""
    return {n: sources[n] for n in ACADEMIC_SOURCES if n in sources}


def mode_of(query: str) -> str:
    """The mode that a query's words ask for: academic or web."""
    low = query.lower()
    return "academic" if any(w in low for w in search.ACADEMIC) else "web"


def unfinished(work: DataFrame, state: DataFrame, key: str, digest: str) -> DataFrame:
    """The rows of ``work`` that no finished row of ``state`` has with the same key and digest: what a resumed run must do.

    ``state``: key, digest, status; a changed digest makes a row new again, a failed one stays to be done.
    """
    done = state.filter("status = 'done'").select(key, digest).distinct()
    return work.join(done, [key, digest], "left_anti")


class Adapters:
    """Functions by language; an unknown or missing language has the default's. Others can be registered."""

    def __init__(self, default: str = "en"):
        self.default, self.known = default, {}

    def register(self, language: str, compute: Callable) -> Callable:
        self.known[language] = compute
        return compute

    def of(self, language: str | None) -> Callable:
        return self.known.get(language or self.default, self.known[self.default])

    def column(self, language, **columns):
        """The adapters' columns chosen by a language column, all on the JVM side."""
        out = None
        for name, compute in self.known.items():
            out = F.when(language == name, compute(**columns)) if out is None else out.when(language == name, compute(**columns))
        return out.otherwise(self.known[self.default](**columns))
