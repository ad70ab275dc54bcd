"""The few places where Spark SQL and DuckDB spell the same expression differently."""

from __future__ import annotations

import re


class Spark:
    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def micros(self, ts: str) -> str:
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})"

    def order(self, *cols: str) -> str:
        return f"struct({', '.join(cols)})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def bytes(self, text: str) -> str:
        return text

    def everywhere(self) -> str:
        """Last argument of a regexp_replace that replaces every match."""
        return ""

    def each(self, values: str, alias: str, column: str) -> str:
        return f"lateral view explode(array({values})) {alias} as {column}"


class Duck:
    def table(self, name: str) -> str:
        return name

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def order(self, *cols: str) -> str:
        return f"row({', '.join(cols)})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def bytes(self, text: str) -> str:
        return f"encode({text})"

    def everywhere(self) -> str:
        return ", 'g'"

    def each(self, values: str, alias: str, column: str) -> str:
        return f"cross join (select unnest([{values}]) as {column}) {alias}"


def render(sql: str, d) -> str:
    """Fill in ``@name(args)`` calls in the given dialect, from the last to the first, so that nested ones come first."""
    while calls := list(re.finditer(r"@\w+\(", sql)):
        at, opened = calls[-1].start(), calls[-1].end() - 1
        name, depth, args, cut, i = sql[at + 1 : opened], 0, [], opened + 1, opened
        while True:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            if not depth or (c == "," and depth == 1):
                args.append(sql[cut:i].strip())
                cut = i + 1
            if not depth:
                break
            i += 1
        text = d.each(", ".join(args[1:]), f"each_{args[0]}", args[0]) if name == "each" else getattr(d, name)(*filter(None, args))
        sql = sql[:at] + text + sql[i + 1 :]
    return sql
