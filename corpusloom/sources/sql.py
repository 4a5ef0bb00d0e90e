"""Bounded read-only SQL over the session's tables or a JDBC database, and table models from DDL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 200, 1000
#: Logical plans that change or administer something.
WRITES = re.compile(r"(?:Insert|Create|Drop|Alter|Delete|Update|Merge|Truncate|Overwrite|Append|Replace|Rename|Command|Set|Cache|Refresh|Analyze|Load|Grant|Revoke|Call|Use)\w*")


def choose_limit(limit: int | None) -> int:
    """A limit between 1 and the highest; none gives the default."""
    return DEFAULT_LIMIT if limit is None else max(1, min(int(limit), MAX_LIMIT))


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether the parsed plan of a statement only reads: all its nodes are checked, not its first word."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if WRITES.match(kind) or "Command" in kind:
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def bounded_sql(spark: SparkSession, sql: str, limit: int | None = None, allow_writes: bool = False) -> tuple[dict, DataFrame]:
    """(meta, rows) of a query, at most ``limit`` rows; anything but a query is refused unless writes are allowed."""
    reads = is_query(spark, sql)
    if not reads and not allow_writes:
        raise PermissionError("only queries are allowed")
    most = choose_limit(limit)
    df = spark.sql(sql)
    return {"read_mode": reads, "limit_applied": most, "max_limit": MAX_LIMIT}, df.limit(most) if reads else df


def jdbc_query(spark: SparkSession, url: str, sql: str, limit: int | None = None, **options: str) -> DataFrame:
    """A query pushed down to a database, with the row cap in the pushed statement."""
    if not is_query(spark, sql):
        raise PermissionError("only queries are allowed")
    capped = f"SELECT * FROM ({sql.strip().rstrip(';')}) bounded LIMIT {choose_limit(limit)}"
    return spark.read.format("jdbc").option("url", url).option("query", capped).options(**options).load()


def jsonable(df: DataFrame) -> DataFrame:
    """One JSON string a row; decimals become doubles, binaries text, times ISO strings - at the sink only."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append((c.cast("double") if kind.startswith("decimal") else F.decode(c, "UTF-8") if kind == "binary" else c).alias(name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def ddl_model(sql: str) -> list[dict]:
    """Tables of CREATE TABLE and ALTER TABLE ... ADD PRIMARY KEY / UNIQUE: name, columns (name, type, nullable, key, unique, default), primary_key, unique_sets."""
    tables: dict[str, dict] = {}
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    name = r"[`\"\[]?(?:\w+[`\"\]]?\.[`\"\[]?)?(\w+)[`\"\]]?"
    for m in re.finditer(rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{name}\s*\(", bare, re.I):
        depth, at, parts, start = 1, m.end(), [], m.end()
        while at < len(bare) and depth:
            ch = bare[at]
            depth += (ch == "(") - (ch == ")")
            if (ch == "," and depth == 1) or depth == 0:
                parts.append(bare[start:at].strip())
                start = at + 1
            at += 1
        table = {"name": m.group(1), "columns": [], "primary_key": [], "unique_sets": []}
        for part in parts:
            listed = [x.strip(" `\"[]") for x in (re.search(r"\((.*)\)", part, re.S) or re.match("()", "")).group(1).split(",")]
            if re.match(r"(?:CONSTRAINT\s+\S+\s+)?PRIMARY\s+KEY", part, re.I):
                table["primary_key"] = listed
            elif re.match(r"(?:CONSTRAINT\s+\S+\s+)?UNIQUE", part, re.I):
                table["unique_sets"].append(listed)
            elif not re.match(r"(?:CONSTRAINT|FOREIGN|CHECK|KEY|INDEX)\b", part, re.I):
                c = re.match(r"[`\"\[]?(\w+)[`\"\]]?\s+(\w+(?:\s*\([^)]*\))?)(.*)", part, re.S)
                if c:
                    rest = c.group(3).upper()
                    default = re.search(r"DEFAULT\s+('[^']*'|\S+)", c.group(3), re.I)
                    key = "PRIMARY KEY" in rest
                    table["columns"].append({"name": c.group(1), "type": re.sub(r"\s+", "", c.group(2)), "nullable": "NOT NULL" not in rest and not key, "unique": "UNIQUE" in rest, "default": default.group(1) if default else None})
                    if key:
                        table["primary_key"] = [c.group(1)]
        tables[table["name"]] = table
    for m in re.finditer(rf"ALTER\s+TABLE\s+(?:ONLY\s+)?{name}\s+ADD\s+(?:CONSTRAINT\s+\S+\s+)?(PRIMARY\s+KEY|UNIQUE)\s*\(([^)]*)\)", bare, re.I):
        if m.group(1) in tables:
            listed = [x.strip(" `\"[]") for x in m.group(3).split(",")]
            if m.group(2)[0] in "pP":
                tables[m.group(1)]["primary_key"] = listed
            else:
                tables[m.group(1)]["unique_sets"].append(listed)
    return list(tables.values())
