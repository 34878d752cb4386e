"""Where plan modules register their queries, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumix.functions.text import NO_BREAK, WIDE, WORD, WS, ZERO_WIDTH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fixture(columns: str, rows: str) -> tuple[Callable[[SparkSession], DataFrame], str]:
    """A small literal table: a function that makes it in Spark, and its text for a WITH clause."""
    return lambda spark: spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})"), f"t({columns}) AS (VALUES {rows})"


class Sql:
    """DuckDB forms of the text functions."""

    @staticmethod
    def re(x: str, *steps: tuple[str, str]) -> str:
        for pattern, by in steps:
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"
        return x

    @staticmethod
    def n(x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {quoted(pattern)}))"

    @classmethod
    def trim(cls, x: str) -> str:
        return cls.re(x, (rf"\A[{WS}]+|[{WS}]+\z", ""))

    @classmethod
    def squeeze(cls, x: str) -> str:
        return cls.trim(cls.re(x, (rf"[{WS}]+", " ")))

    @classmethod
    def truncate(cls, x: str, most: int = 200) -> str:
        return f"CASE WHEN length({x}) > {most} THEN left({x}, {most}) || '…' ELSE {x} END"

    @classmethod
    def normalize(cls, x: str) -> str:
        return cls.trim(cls.re(x, ("\r\n", "\n"), (f"[{ZERO_WIDTH}]", ""), (f"[{NO_BREAK}]", " "), (r"[ \t]+([\n\r\x{2028}\x{2029}]|\z)", r"\1"), (r"\n{3,}", "\n\n")))

    @classmethod
    def words(cls, x: str) -> str:
        return f"CAST({cls.n(x, f'[{WIDE}]')} + {cls.n(cls.re(x, (f'[{WIDE}]', ' ')), WORD)} AS BIGINT)"

    @classmethod
    def strip_html(cls, x: str) -> str:
        x = cls.re(x, (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", ""), (r"(?s)<!--.*?-->", ""), ("<[^>]*>", ""))
        return cls.trim(cls.re(x, ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")))

    @classmethod
    def folder(cls, x: str, fallback: str = "untitled") -> str:
        ends = (rf"\A[{WS}._]+|[{WS}._]+\z", "")
        x = cls.re(x, (r"[\x00-\x1F\x7F]", ""), (r'[\\/:*?"<>|]', "_"), ("_+", "_"), (rf"[{WS}]+", " "), ends)
        x = f"coalesce(nullif({cls.re(f'left({x}, 100)', ends)}, ''), {quoted(fallback)})"
        stem = rf"(?i)\A(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])[{WS}]*(?:\..*)?\z"
        fixed = cls.re(f"left({cls.re(x, (r'\A([^.]*)', r'\1_'))}, 100)", (rf"[{WS}.]+\z", ""))
        return f"CASE WHEN regexp_matches({x}, {quoted(stem)}) THEN {fixed} ELSE {x} END"

    @staticmethod
    def one(x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {quoted(pattern)}, {group})"

    @classmethod
    def host(cls, x: str) -> str:
        return f"lower({cls.one(x, r'(?s)\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#\[\]@]+)')})"

    @classmethod
    def element(cls, x: str, tag: str) -> str:
        return cls.squeeze(cls.re(cls.one(x, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), ("<[^>]*>", "")))
