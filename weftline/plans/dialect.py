"""The few expressions that Spark SQL and the checking SQL engine spell differently."""

from __future__ import annotations

import re


class Spark:
    """Expressions as Spark SQL has them."""

    def rounding(self, sql: str) -> str:
        """``sql`` with every ``round(x, n)`` of a literal n above 0 computed as the checking engine does: x is scaled, rounded to a whole number and scaled back. Spark's own form rounds the shortest decimal text of x, which differs where that text ends in a 5."""
        out, at = "", 0
        for m in re.finditer(r"\bround\(", sql):
            if m.start() < at:
                continue
            depth, quoted, comma, i = 1, False, -1, m.end()
            while depth:
                c = sql[i]
                quoted ^= c == "'"
                depth += 0 if quoted else (c == "(") - (c == ")")
                comma = i if c == "," and depth == 1 and not quoted else comma
                i += 1
            digits = sql[comma + 1 : i - 1].strip() if comma >= 0 else ""
            inner = self.rounding(sql[m.end() : comma if digits.isdigit() else i - 1])
            out += sql[at : m.start()] + (f"(round(({inner}) * 1e{digits}, 0) / 1e{digits})" if digits.isdigit() and int(digits) else f"round({inner}{', ' + digits if digits.isdigit() else ''})")
            at = i
        return out + sql[at:]

    def total(self, x: str) -> str:
        """A sum of doubles that does not depend on the order of the rows, so that equal sums tie."""
        return f"cast(sum(cast({x} as decimal(38, 22))) as double)"

    def since(self, p, days: int) -> str:
        """The relation to read for events of the last ``days`` days before the cutoff: the staged window where it reaches that far."""
        return "recent" if days <= p.history_days else "history"

    def days(self, start: str, end: str) -> str:
        """Whole days from start to end."""
        return f"cast(datediff({end}, {start}) as bigint)"

    def date(self, text: str) -> str:
        return f"DATE '{text}'"

    def shift(self, date: str, days: int | str) -> str:
        return f"date_add({date}, cast({days} as int))"

    def month(self, date: str) -> str:
        return f"trunc({date}, 'MM')"

    def median(self, x: str) -> str:
        return f"cast(median({x}) as double)"

    def quantile(self, x: str, q: float) -> str:
        return f"cast(percentile({x}, {q}) as double)"

    def joined(self, x: str, order: str, sep: str = ",") -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    def arg_max(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})"

    def number(self, digest: str) -> str:
        """The first 32 bits of a hex digest."""
        return f"cast(conv(substring({digest}, 1, 8), 16, 10) as bigint)"

    def text(self, x: str) -> str:
        return f"cast({x} as string)"

    def first_word(self, x: str) -> str:
        return f"split({x}, ' ')[0]"

    def try_int(self, x: str) -> str:
        return f"try_cast({x} as int)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, x) -> s + x)"

    def spread(self, keys: str, array: str, index: str, value: str, source: str, where: str = "true") -> str:
        """Rows (keys, index, value) of an array column, index from 0."""
        return f"SELECT {keys}, cast(p as bigint) AS {index}, cast(v as double) AS {value} FROM {source} LATERAL VIEW posexplode({array}) t AS p, v WHERE {where}"

    def stacked(self, keys: str, columns: tuple[str, ...], source: str) -> str:
        """Rows (keys, dimension, value as text), one for each column, in one pass."""
        each = ", ".join(f"struct('{c}' AS dimension, cast({c} as string) AS value)" for c in columns)
        return f"SELECT {keys}, e.dimension, e.value FROM {source} LATERAL VIEW explode(array({each})) t AS e"

    def numbers(self, n: int, name: str) -> str:
        return f"SELECT id AS {name} FROM range(1, {n + 1})"


class Duck(Spark):
    """The same expressions for DuckDB."""

    def rounding(self, sql: str) -> str:
        return sql

    def total(self, x: str) -> str:
        return f"sum({x})"

    def since(self, p, days: int) -> str:
        return "history"

    def days(self, start: str, end: str) -> str:
        return f"date_diff('day', {start}, {end})"

    def shift(self, date: str, days: int | str) -> str:
        return f"cast({date} + cast({days} as int) as date)"

    def month(self, date: str) -> str:
        return f"cast(date_trunc('month', {date}) as date)"

    def median(self, x: str) -> str:
        return f"cast(median({x}) as double)"

    def quantile(self, x: str, q: float) -> str:
        return f"cast(quantile_cont({x}, {q}) as double)"

    def joined(self, x: str, order: str, sep: str = ",") -> str:
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def arg_max(self, x: str, by: str) -> str:
        return f"arg_max({x}, {by})"

    def number(self, digest: str) -> str:
        return f"cast('0x' || substr({digest}, 1, 8) as bigint)"

    def text(self, x: str) -> str:
        return f"cast({x} as varchar)"

    def first_word(self, x: str) -> str:
        return f"string_split({x}, ' ')[1]"

    def dot(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: cast(z[1] as double) * cast(z[2] as double)))"

    def spread(self, keys: str, array: str, index: str, value: str, source: str, where: str = "true") -> str:
        return f"SELECT {keys}, p - 1 AS {index}, cast({array}[p] as double) AS {value} FROM (SELECT *, unnest(range(1, len({array}) + 1)) AS p FROM {source}) WHERE {where}"

    def stacked(self, keys: str, columns: tuple[str, ...], source: str) -> str:
        return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS dimension, cast({c} as varchar) AS value FROM {source}" for c in columns)

    def numbers(self, n: int, name: str) -> str:
        return f"SELECT range AS {name} FROM range(1, {n + 1})"


SPARK, DUCK = Spark(), Duck()
