"""Sinks: canonical JSON, reports, and content-addressed copies of results. Driver-side ones take aggregates only."""

from __future__ import annotations

import hashlib
import json
import math
import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rounded(value: object, digits: int = 6) -> object:
    """Floats rounded through nested lists and dicts; NaN and infinities become None."""
    if isinstance(value, float):
        return round(value, digits) if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [rounded(v, digits) for v in value]
    return value


def canonical_json(value: object) -> str:
    """The one text of a value: keys sorted, floats rounded, a line feed at the end."""
    return json.dumps(rounded(value), sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n"


def bounded_rows(df: DataFrame, most: int = 100_000) -> list[dict]:
    """Rows of an aggregate as dicts; more than ``most`` is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them with a distributed sink")
    return [r.asDict(recursive=True) for r in rows]


def markdown_table(df: DataFrame, most: int = 1_000) -> str:
    """A report table of an aggregate."""
    rows = bounded_rows(df, most)
    text = lambda v: "" if v is None else str(rounded(v)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(text(r[c]) for c in df.columns) + " |" for r in rows]) + "\n"


def yaml_clauses(df: DataFrame) -> str:
    """The clauses of a contract as deterministic YAML: a list ordered by metric, strings quoted."""
    out = []
    for r in sorted(bounded_rows(df), key=lambda r: r["metric"]):
        for i, (k, v) in enumerate(sorted(r.items(), key=lambda kv: (kv[0] != "metric", kv[0]))):
            shown = "null" if v is None else json.dumps(rounded(v), ensure_ascii=False)
            out.append(("- " if i == 0 else "  ") + f"{k}: {shown}")
    return "\n".join(out) + "\n"


def append_history(df: DataFrame, path: str) -> None:
    """Search history as parquet, by day."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """An annotation sheet: tab-separated with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An annotation sheet as it comes back, all columns as text."""
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def write_products(products: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each product as parquet below ``folder`` with a digest of its rows; the manifest is the return value and a file.

    Digests are folded on the cluster (``operators.profile.fingerprints``); only one row a product reaches the driver.
    """
    from corpusloom.operators import profile

    manifest = {}
    for name, df in sorted(products.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        rows = df.sparkSession.read.parquet(f"{folder}/{name}")
        parts = [F.to_json(F.struct(*sorted(rows.columns)))]
        found = profile.fingerprints(rows.withColumn("__all", F.lit(0)), "__all", parts).collect()
        manifest[name] = found[0]["fingerprint"] if found else hashlib.sha256(b"").hexdigest()
    Path(folder, "manifest.json").write_text(canonical_json(manifest), encoding="utf-8")
    return manifest


def validation_report(validated: DataFrame) -> tuple[str, str]:
    """(text, JSON) of validated clauses: verdicts first, then a line for each clause that failed or warned."""
    rows = sorted(bounded_rows(validated), key=lambda r: (str(r.get("draft_id")), r["metric"]))
    counts: dict[str, int] = {}
    for r in rows:
        counts[r["verdict"]] = counts.get(r["verdict"], 0) + 1
    lines = [", ".join(f"{k}: {n}" for k, n in sorted(counts.items()))]
    lines += [f"{r['verdict']}\t{r['metric']}\t{rounded(r.get('value'))}" for r in rows if r["verdict"] in ("fail", "warn")]
    return "\n".join(lines) + "\n", canonical_json({"counts": counts, "clauses": rows})


def read_yaml_clauses(text: str) -> list[dict]:
    """What ``yaml_clauses`` wrote: a list of flat mappings; any other line is an error."""
    out: list[dict] = []
    for no, line in enumerate(text.splitlines(), 1):
        m = re.fullmatch(r"(- |  )([\w.-]+): (.*)", line)
        if not m or (m.group(1) == "  " and not out):
            raise ValueError(f"line {no} is no clause")
        if m.group(1) == "- ":
            out.append({})
        out[-1][m.group(2)] = json.loads(m.group(3))
    return out


def backup_file(path: str, store: str) -> dict[str, object]:
    """A copy of a file under its digest, and the line of the manifest; a copy that is there already is kept."""
    data = Path(path).read_bytes()
    digest = hashlib.sha256(data).hexdigest()
    target = Path(store, digest[:2], digest)
    kept = target.exists()
    if not kept:
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(path, target)
    line = {"name": Path(path).name, "sha256": digest, "bytes": len(data), "kept": kept}
    with Path(store, "manifest.jsonl").open("a", encoding="utf-8") as f:
        f.write(canonical_json(line))
    return line


def write_paper(blocks: DataFrame, meta: DataFrame, folder: str) -> None:
    """Canonical papers: blocks and provenance by paper."""
    blocks.write.mode("overwrite").partitionBy("paper_key").parquet(f"{folder}/blocks")
    meta.write.mode("overwrite").parquet(f"{folder}/meta")


def export_snapshot(inventory: DataFrame, path: str) -> None:
    """An inventory (an aggregate) as JSON and as an HTML table beside it."""
    rows = bounded_rows(inventory, 10_000)
    Path(path + ".json").write_text(canonical_json(rows), encoding="utf-8")
    escape = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;")
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape(v)}</{tag}>" for v in values) + "</tr>"
    body = [cells("th", inventory.columns), *(cells("td", [r[c] for c in inventory.columns]) for r in rows)]
    Path(path + ".html").write_text("<table>" + "".join(body) + "</table>\n", encoding="utf-8")


def resolve_config(explicit: str | None, env: dict[str, str], variable: str, candidates: list[str]) -> str | None:
    """The first that is there: the explicit path (an error if missing), the variable's, the candidates in order."""
    if explicit:
        if not Path(explicit).exists():
            raise FileNotFoundError(explicit)
        return explicit
    named = env.get(variable)
    return next((p for p in ([named] if named else []) + candidates if Path(p).exists()), None)
