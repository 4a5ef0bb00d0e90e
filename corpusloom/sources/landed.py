"""Search and usage responses that were landed as rows, brought to one shape.

Calling the services is left to whoever lands the responses; here every source's body becomes result rows
(source, place, title, url, snippet, doi, arxiv_id, year, venue, citation_count, error), malformed ones an error row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULTS = "query_id bigint, source string, place int, title string, url string, snippet string, doi string, arxiv_id string, year int, venue string, citation_count int, error string"
FIELDS = [f.split(" ")[0] for f in RESULTS.split(", ")]
TAGS, BLANKS = re.compile(r"<[^>]+>"), re.compile(r"\s+")


def squeeze(text: object) -> str:
    return BLANKS.sub(" ", TAGS.sub(" ", str(text or ""))).strip()


def abstract(index: dict | None, most: int = 1500) -> str:
    """The text of an inverted index word -> positions, up to ``most`` words."""
    pairs = sorted((p, w) for w, ps in (index or {}).items() for p in ps)
    return " ".join(w for _, w in pairs[:most])


def _openalex(body: str) -> Iterator[dict]:
    for w in json.loads(body)["results"]:
        venue = ((w.get("primary_location") or {}).get("source") or {}).get("display_name")
        yield {"title": squeeze(w.get("title")), "url": w.get("id"), "snippet": abstract(w.get("abstract_inverted_index")), "doi": re.sub(r"^https?://doi\.org/", "", w.get("doi") or "") or None, "year": w.get("publication_year"), "venue": venue, "citation_count": w.get("cited_by_count")}


def _semantic(body: str) -> Iterator[dict]:
    for p in json.loads(body)["data"]:
        ids = p.get("externalIds") or {}
        yield {"title": squeeze(p.get("title")), "url": p.get("url"), "snippet": squeeze(p.get("abstract")), "doi": ids.get("DOI"), "arxiv_id": ids.get("ArXiv"), "year": p.get("year"), "venue": p.get("venue") or None, "citation_count": p.get("citationCount")}


def _dblp(body: str) -> Iterator[dict]:
    for h in (json.loads(body)["result"]["hits"].get("hit") or []):
        i = h["info"]
        yield {"title": squeeze(i.get("title")).rstrip("."), "url": i.get("ee") or i.get("url"), "doi": i.get("doi"), "year": int(i["year"]) if str(i.get("year", "")).isdigit() else None, "venue": i.get("venue") if isinstance(i.get("venue"), str) else None}


def _atom(body: str) -> Iterator[dict]:
    ns = {"a": "http://www.w3.org/2005/Atom"}
    for e in ElementTree.fromstring(body).findall("a:entry", ns):
        text = lambda tag, e=e: squeeze((e.find(f"a:{tag}", ns).text if e.find(f"a:{tag}", ns) is not None else ""))
        url, at = text("id"), text("published")
        found = re.search(r"abs/([^/\s]+?)(?:v\d+)?$", url)
        yield {"title": text("title"), "url": url, "snippet": text("summary"), "arxiv_id": found.group(1) if found else None, "year": int(at[:4]) if at[:4].isdigit() else None}


def _flat(body: str) -> Iterator[dict]:
    """Web search services: a list of results under one of several names."""
    data = json.loads(body)
    for name in ("results", "search_result", "data", "webPages"):
        found = data.get(name) if isinstance(data, dict) else None
        if isinstance(found, dict):
            found = found.get("value") or found.get("web")
        if isinstance(found, list):
            for r in found:
                yield {"title": squeeze(r.get("title") or r.get("name")), "url": r.get("url") or r.get("link"), "snippet": squeeze(r.get("content") or r.get("snippet") or r.get("summary") or r.get("description"))}
            return
    raise KeyError("no list of results")


PARSERS: dict[str, Callable[[str], Iterator[dict]]] = {"openalex": _openalex, "semantic_scholar": _semantic, "dblp": _dblp, "arxiv": _atom}


def parse_responses(responses: DataFrame) -> DataFrame:
    """Result rows of landed responses (query_id, source, body); a source without a parser of its own is read as a web search."""

    def run(batches):
        for batch in batches:
            rows = []
            for q, source, body in zip(batch["query_id"], batch["source"], batch["body"], strict=True):
                try:
                    if body is None:
                        raise ValueError("no body")
                    found = list(PARSERS.get(source, _flat)(body))
                    rows += [{"query_id": q, "source": source, "place": i, **r} for i, r in enumerate(found)]
                except (ValueError, KeyError, TypeError, AttributeError, ElementTree.ParseError) as e:
                    rows.append({"query_id": q, "source": source, "place": 0, "error": type(e).__name__})
            yield pd.DataFrame([tuple(r.get(f) for f in FIELDS) for r in rows], columns=FIELDS, dtype=object)

    return responses.select("query_id", "source", "body").mapInPandas(run, RESULTS)


def first_page(pages: DataFrame, order: list[str]) -> DataFrame:
    """url, source, body: each page from the first source, in order, that has a body that isn't blank."""
    place = F.create_map(*[F.lit(x) for kv in ((s, i) for i, s in enumerate(order)) for x in kv])
    ok = pages.filter(F.col("source").isin(*order) & (F.length(F.trim(F.coalesce("body", F.lit("")))) > 0))
    return ok.groupBy("url").agg(F.min_by(F.struct("source", "body"), place[F.col("source")]).alias("p")).select("url", "p.source", "p.body")


def clamp_percent(value: Column) -> Column:
    """A percentage between 0 and 100 with one digit; null for null."""
    return F.when(value.isNotNull(), F.round(F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(100.0)), 1))


def usage_windows(polls: DataFrame) -> DataFrame:
    """provider, used_percent, window_minutes, resets_at, failed of the providers' latest polls; one that failed has nulls."""
    latest = polls.groupBy("provider").agg(F.max_by(F.struct("used_percent", "window_minutes", "resets_at_ms", "error"), "polled_at").alias("p"))
    resets = F.timestamp_millis(F.col("p.resets_at_ms"))
    return latest.select("provider", clamp_percent(F.col("p.used_percent")).alias("used_percent"), "p.window_minutes", resets.alias("resets_at"), F.col("p.error").isNotNull().alias("failed"))
