"""Object Select: one SELECT over CSV, JSON or Parquet objects.

Two modes. ``strict`` gives the statement to Spark SQL over a view named s3object. ``compat`` parses the small subset
that object selection knows (columns, WHERE, LIMIT) and gives its rules: cells are typed one by one, a missing column
makes its expression missing, NULL = NULL is true, mixed types differ, division by zero is missing, LIKE is an
unescaped pattern. A value is a struct (k, n, s, b): its kind, and a number, text or boolean; kind null is JSON null, and
a null struct is missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "__row"


@dataclass
class CsvInput:
    header: str = "NONE"  # USE, IGNORE or NONE
    delimiter: str = ","


@dataclass
class JsonInput:
    type: str = "LINES"  # or DOCUMENT


@dataclass
class ScanRange:
    start: int | None = None
    end: int | None = None


@dataclass
class SelectRequest:
    expression: str
    input: CsvInput | JsonInput | None = field(default_factory=CsvInput)  # None: Parquet
    mode: str = "strict"
    scan_range: ScanRange | None = None

    @classmethod
    def parse(cls, body: dict) -> SelectRequest:
        """From the request's JSON form; only SQL expressions are known."""
        if body.get("ExpressionType", "SQL").upper() != "SQL":
            raise ValueError("only SQL expressions")
        source = body.get("InputSerialization", {})
        given: CsvInput | JsonInput | None = None
        if "CSV" in source:
            given = CsvInput(source["CSV"].get("FileHeaderInfo", "NONE").upper(), source["CSV"].get("FieldDelimiter", ",")[:1])
        elif "JSON" in source:
            given = JsonInput(source["JSON"].get("Type", "LINES").upper())
        elif "Parquet" not in source:
            raise ValueError("an input form is needed")
        r = body.get("ScanRange")
        return cls(body["Expression"], given, body.get("Mode", "strict"), ScanRange(r.get("Start"), r.get("End")) if r else None)


def value(kind: str, n=None, s=None, b=None) -> Column:
    lit = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(F.lit(kind).alias("k"), lit(n, "double").alias("n"), lit(s, "string").alias("s"), lit(b, "boolean").alias("b"))


MISSING = "struct<k: string, n: double, s: string, b: boolean>"


def cell(text: Column) -> Column:
    """A CSV cell by itself: integer, float, boolean in any case, empty as null, else text. NaN and infinity are text."""
    number = text.rlike(r"^[+-]?\d+$") | text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    truth = F.lower(text).isin("true", "false")
    return (
        F.when(text.isNull(), F.lit(None).cast(MISSING))
        .when(text == "", value("null"))
        .when(number, value("n", n=text.try_cast("double")))
        .when(truth, value("b", b=F.lower(text) == "true"))
        .otherwise(value("s", s=text))
    )


# --- the subset's grammar ---------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|('(?:[^']|'')*'|\"[^\"]*\")|([A-Za-z_][A-Za-z_0-9]*(?:\.[A-Za-z_][A-Za-z_0-9]*)?)|(<>|!=|<=|>=|\|\||[=<>+\-*/%(),;]))")


class Parser:
    """Recursive descent over SELECT columns FROM s3object [WHERE predicate] [LIMIT n]."""

    def __init__(self, sql: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        sql = sql.strip()
        while at < len(sql):
            m = _TOKEN.match(sql, at)
            if not m:
                raise ValueError(f"can't read the statement at {sql[at:at + 20]!r}")
            kind = ("number", "string", "name", "op")[next(i for i in range(4) if m[i + 1] is not None)]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.i = 0

    def peek(self) -> str:
        return self.tokens[self.i][1].upper() if self.i < len(self.tokens) and self.tokens[self.i][0] in ("name", "op") else ""

    def take(self, *words: str) -> bool:
        if self.peek() in words:
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ValueError(f"{word} expected")

    def statement(self) -> dict:
        self.need("SELECT")
        columns: list[tuple] | None = []
        while True:
            if self.take("*"):
                columns = None
            else:
                e = self.either()
                alias = None
                if self.take("AS"):
                    alias = self.tokens[self.i][1]
                    self.i += 1
                if columns is not None:
                    columns.append((e, alias))
            if not self.take(","):
                break
        self.need("FROM")
        self.i += 1
        if self.i < len(self.tokens) and self.tokens[self.i][0] == "name" and self.peek() not in ("WHERE", "LIMIT"):
            if self.peek() in ("JOIN", "GROUP", "ORDER", "HAVING", "UNION", "INNER", "LEFT"):
                raise ValueError(f"{self.peek()} isn't part of the subset")
            self.i += 1  # a table alias
        where = self.either() if self.take("WHERE") else None
        limit = None
        if self.take("LIMIT"):
            limit = int(self.tokens[self.i][1])
            self.i += 1
        self.take(";")
        if self.i < len(self.tokens):
            raise ValueError(f"{self.tokens[self.i][1]} isn't part of the subset")
        return {"columns": columns, "where": where, "limit": limit}

    def either(self):
        left = self.both()
        while self.take("OR"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.compare()
        while self.take("AND"):
            left = ("and", left, self.compare())
        return left

    def compare(self):
        left = self.add()
        while True:
            no = self.peek() == "NOT" and self.i + 1 < len(self.tokens) and self.tokens[self.i + 1][1].upper() in ("IN", "BETWEEN", "LIKE")
            if no:
                self.i += 1
            if self.take("IS"):
                no = self.take("NOT")
                self.need("NULL")
                left = ("is_null", left, no)
            elif self.take("IN"):
                self.need("(")
                items = [self.add()]
                while self.take(","):
                    items.append(self.add())
                self.need(")")
                left = ("in", left, items, no)
            elif self.take("BETWEEN"):
                low = self.add()
                self.need("AND")
                left = ("between", left, low, self.add(), no)
            elif self.take("LIKE"):
                left = ("like", left, self.add(), no)
            elif self.peek() in ("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.peek()
                self.i += 1
                left = ("<>" if op == "!=" else op, left, self.add())
            else:
                return left

    def add(self):
        left = self.times()
        while self.peek() in ("+", "-", "||"):
            op = self.peek()
            self.i += 1
            left = (op, left, self.times())
        return left

    def times(self):
        left = self.atom()
        while self.peek() in ("*", "/", "%"):
            op = self.peek()
            self.i += 1
            left = (op, left, self.atom())
        return left

    def atom(self):
        if self.take("("):
            e = self.either()
            self.need(")")
            return e
        kind, text = self.tokens[self.i]
        self.i += 1
        if kind == "number":
            return ("number", float(text))
        if kind == "string":
            return ("string", text[1:-1].replace("''", "'") if text[0] == "'" else text[1:-1])
        if kind == "name":
            if text.upper() in ("TRUE", "FALSE"):
                return ("bool", text.upper() == "TRUE")
            if text.upper() == "NULL":
                return ("null",)
            return ("column", text)
        raise ValueError(f"{text} isn't part of the subset")


# --- the subset's meaning ---------------------------------------------------------------------------------------------


def evaluate(e: tuple, column: Callable[[str], Column]) -> Column:
    """An expression as a value struct; null is missing."""
    op = e[0]
    missing = F.lit(None).cast(MISSING)
    if op == "number":
        return value("n", n=e[1])
    if op == "string":
        return value("s", s=e[1])
    if op == "bool":
        return value("b", b=e[1])
    if op == "null":
        return value("null")
    if op == "column":
        return column(e[1])
    a = evaluate(e[1], column)
    if op == "is_null":
        hit = a.isNull() | (a["k"] == "null")
        return value("b", b=~hit if e[2] else hit)

    def flip(hit: Column, no: bool) -> Column:
        return value("b", b=~hit if no else hit)

    if op == "in":
        hit = F.lit(False)
        for item in e[2]:
            hit = hit | F.coalesce(same(a, evaluate(item, column)), F.lit(False))
        return F.when(a.isNotNull(), flip(hit, e[3])).otherwise(missing)
    if op == "between":
        low, high = evaluate(e[2], column), evaluate(e[3], column)
        hit = F.coalesce((order(a, low) >= 0) & (order(a, high) <= 0), F.lit(False))
        return F.when(a.isNotNull() & low.isNotNull() & high.isNotNull(), flip(hit, e[4])).otherwise(missing)
    b = evaluate(e[2], column)
    there = a.isNotNull() & b.isNotNull()
    if op == "like":
        strings = (a["k"] == "s") & (b["k"] == "s")
        pattern = F.concat(F.lit("^"), F.replace(F.replace(b["s"], F.lit("%"), F.lit(".*")), F.lit("_"), F.lit(".")), F.lit("$"))
        hit = F.regexp(a["s"], pattern)
        return F.when(there, value("b", b=F.coalesce(F.when(strings, ~hit if e[3] else hit), F.lit(False)))).otherwise(missing)
    if op in ("and", "or"):
        ok = there & (a["k"] == "b") & (b["k"] == "b")
        return F.when(ok, value("b", b=(a["b"] & b["b"]) if op == "and" else (a["b"] | b["b"]))).otherwise(missing)
    if op == "=":
        return F.when(there, value("b", b=same(a, b))).otherwise(missing)
    if op == "<>":
        return F.when(there, value("b", b=~same(a, b))).otherwise(missing)
    if op in ("<", "<=", ">", ">="):
        c = order(a, b)
        hit = {"<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]
        return F.when(there & c.isNotNull(), value("b", b=hit)).otherwise(missing)
    if op == "||":
        return F.when(there & (a["k"] == "s") & (b["k"] == "s"), value("s", s=F.concat(a["s"], b["s"]))).otherwise(missing)
    x, y = a["n"], b["n"]
    n = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.try_mod(x, y)}[op]
    return F.when(there & (a["k"] == "n") & (b["k"] == "n") & n.isNotNull() & ~F.isnan(n), value("n", n=n)).otherwise(missing)


def same(a: Column, b: Column) -> Column:
    """Equality of values: nulls are equal, different kinds are not."""
    return (a["k"] == b["k"]) & a["n"].eqNullSafe(b["n"]) & a["s"].eqNullSafe(b["s"]) & a["b"].eqNullSafe(b["b"])


def order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two numbers or two texts; else null."""
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when((a["k"] == "n") & (b["k"] == "n"), sign(a["n"], b["n"])).when((a["k"] == "s") & (b["k"] == "s"), sign(a["s"], b["s"]))


def typed(dtype: str, c: Column) -> Column:
    """A column of a known type as values."""
    if dtype == "boolean":
        return F.when(c.isNull(), value("null")).otherwise(value("b", b=c))
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return F.when(c.isNull(), value("null")).otherwise(value("n", n=c))
    if dtype == "variant":  # values of several types under one name: each has its own
        kind = F.schema_of_variant(c)
        number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")
        return F.when(c.isNull() | (kind == "VOID"), value("null")).when(number, value("n", n=F.try_variant_get(c, "$", "double"))).when(kind == "BOOLEAN", value("b", b=F.try_variant_get(c, "$", "boolean"))).otherwise(value("s", s=F.try_variant_get(c, "$", "string")))
    return F.when(c.isNull(), value("null")).otherwise(value("s", s=c))


def compat(df: DataFrame, sql: str, cells: str = "typed") -> DataFrame:
    """The subset's statement over a table. cells: 'typed' columns, or 'csv' texts that are typed cell by cell."""
    q = Parser(sql).statement()
    kinds = dict(df.dtypes)

    def column(name: str) -> Column:
        if name not in kinds:  # unknown, or qualified
            return F.lit(None).cast(MISSING)
        return cell(F.col(f"`{name}`")) if cells == "csv" else typed(kinds[name], F.col(f"`{name}`"))

    if q["where"] is not None:
        kept = evaluate(q["where"], column)
        df = df.where((kept["k"] == "b") & kept["b"])
    if q["limit"] is not None:
        df = (df.orderBy(ROW) if ROW in kinds else df).limit(q["limit"])
    shown = [c for c in df.columns if c != ROW]
    if q["columns"] is None:
        return df.select(*[f"`{c}`" for c in shown])
    out = []
    for e, alias in q["columns"]:
        if e[0] == "column" and e[1] in kinds:
            out.append(F.col(f"`{e[1]}`").alias(alias or e[1]))
        elif e[0] != "column":
            v = evaluate(e, column)
            out.append(F.when(v["k"] == "n", v["n"].cast("string")).when(v["k"] == "b", v["b"].cast("string")).otherwise(v["s"]).alias(alias or f"_{len(out) + 1}"))
    return df.select(*out)


# --- sources ----------------------------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, given: CsvInput) -> DataFrame:
    """All cells as texts. Names come from the header with USE; else _1, _2, ...; IGNORE skips the first line."""
    df = spark.read.csv(path, header=given.header == "USE", sep=given.delimiter, inferSchema=False, nullValue="\x00", emptyValue="")
    if given.header != "USE":
        df = df.toDF(*[f"_{i + 1}" for i in range(len(df.columns))])
        if given.header == "IGNORE":
            return df.withColumn(ROW, F.monotonically_increasing_id()).where(F.col(ROW) > 0)
    return df.withColumn(ROW, F.monotonically_increasing_id())


def read_json(spark: SparkSession, path: str, given: JsonInput) -> DataFrame:
    """Objects as rows; other values as _1. A bad line fails the request."""
    whole = given.type == "DOCUMENT"
    raw = spark.read.text(path, wholetext=whole).where("trim(value) <> ''")
    v = raw.select(F.when(F.trim("value") != "", F.parse_json("value")).alias("v"))  # the optimiser may move the filter
    if whole:
        kind = F.schema_of_variant("v")
        many = v.where(F.startswith(kind, F.lit("ARRAY"))).select(F.explode(F.col("v").cast("array<variant>")).alias("v"))
        v = many.unionByName(v.where(~F.startswith(kind, F.lit("ARRAY"))))
    is_object = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    found = v.where(is_object).agg(F.schema_of_variant_agg("v")).head()[0]
    fields = found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING") if found and "<" in found and found != "OBJECT<>" else None
    rows = v.select(F.when(is_object, F.from_json(F.to_json("v"), fields)).alias("o") if fields else F.lit(None).alias("o"), F.when(~is_object, F.col("v").cast("string")).alias("_1"), F.monotonically_increasing_id().alias(ROW))
    names = [F.col(f"o.`{f.name}`").alias(f.name) for f in rows.schema["o"].dataType.fields] if fields else []
    lone = not v.where(~is_object).isEmpty()
    return rows.select(*names, *(["_1"] if lone or not names else []), ROW)


def read_range(spark: SparkSession, path: str, r: ScanRange) -> DataFrame:
    """The lines of the bytes [start, end) of one object, as they stand: the ends may cut a line."""
    raw = spark.read.format("binaryFile").load(path)
    n = F.octet_length("content")
    start = F.least(F.lit(r.start or 0), n)
    end = F.least(F.lit(r.end), n) if r.end is not None else n
    part = F.when(end > start, F.substring(F.col("content"), start + 1, end - start)).otherwise(F.lit(b""))
    return raw.select(F.posexplode(F.split(F.decode(part, "UTF-8"), "\n")).alias(ROW, "value")).where("value <> ''")


def select(spark: SparkSession, path: str, request: SelectRequest) -> DataFrame:
    """Run a request over an object."""
    given = request.input
    if request.scan_range and isinstance(given, CsvInput):
        lines = read_range(spark, path, request.scan_range)
        parts = F.split("value", re.escape(given.delimiter))
        width = lines.agg(F.max(F.size(parts))).head()[0] or 1
        df = lines.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(f"_{i + 1}") for i in range(width)], ROW)
    elif isinstance(given, CsvInput):
        df = read_csv(spark, path, given)
    elif isinstance(given, JsonInput):
        df = read_json(spark, path, given)
    else:
        df = spark.read.parquet(path)
    if request.mode == "compat":
        return compat(df, request.expression, "csv" if isinstance(given, CsvInput) else "typed")
    df.drop(ROW).createOrReplaceTempView("s3object")
    return spark.sql(request.expression)


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """No header; columns in their order; null is empty."""
    df.write.csv(path, header=False, sep=delimiter, nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    """One object per line."""
    df.write.json(path, ignoreNullFields=False)
