"""Named pieces of DuckDB SQL; an oracle statement pulls in the pieces it mentions."""

import re

PIECES: dict[str, str] = {}


def piece(name: str, sql: str) -> None:
    assert name not in PIECES, name
    PIECES[name] = sql.strip()


def R(expr: str, digits: int) -> str:
    """Half-up rounding, as functions.cols.half_up does it."""
    return f"(floor(({expr})*1e{digits}+0.5)/1e{digits})"


def _mentions(sql: str) -> list[str]:
    return [w for w in dict.fromkeys(re.findall(r"\bq_\w+", sql)) if w in PIECES]


def statement(final: str) -> str:
    done: dict[str, str] = {}

    def visit(name):
        if name not in done:
            for dep in _mentions(PIECES[name]):
                if dep != name:
                    visit(dep)
            done[name] = PIECES[name]

    for name in _mentions(final):
        visit(name)
    if not done:
        return final
    body = ",\n".join(f"{k} AS MATERIALIZED (\n{v}\n)" for k, v in done.items())
    if final.lstrip().startswith("WITH "):  # the pieces join its own list
        return f"WITH {body},\n{final.lstrip()[5:]}"
    return f"WITH {body}\n{final}"


CHECKS: dict[str, tuple] = {}


def check(name: str, spark_query, final: str | None) -> None:
    """Register one query with its oracle (None where SQL cannot say it)."""
    assert name not in CHECKS, name
    CHECKS[name] = (spark_query, final)
