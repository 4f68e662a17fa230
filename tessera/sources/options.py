"""Options files: nested ``name: value`` lines, lists of ``- value`` lines and comments, as used for settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


#: A comment: a # behind white space and no open quote.
_COMMENT = re.compile(r"""(?<=\s)#(?=(?:[^"]*"[^"]*")*[^"]*$)(?=(?:[^']*'[^']*')*[^']*$).*""")


def parse(body: str) -> dict[str, str | None]:
    """Values by dotted name; items of a list are numbered from 0. A name without a value that nothing follows is null."""
    found: dict[str, str | None] = {}
    path: list[tuple[int, str]] = []  # indentation and name of the open levels
    items: dict[str, int] = {}
    for line in body.splitlines():
        text = _COMMENT.sub("", line).rstrip()
        if not text.strip() or text.lstrip().startswith("#"):
            continue
        depth, text = len(text) - len(text.lstrip()), text.strip()
        is_item = text.startswith("- ")
        while path and (path[-1][0] > depth or path[-1][0] == depth and not is_item):
            path.pop()
        above = ".".join(name for _, name in path)
        if is_item:
            found.pop(above, None)
            k = items[above] = items.get(above, -1) + 1
            found[f"{above}.{k}"] = _plain(text[2:])
            continue
        name, _, value = text.partition(":")
        found.pop(above, None)
        path.append((depth, _plain(name) or ""))
        found[".".join(name for _, name in path)] = _plain(value)
    return found


def _plain(value: str) -> str | None:
    """A value without quotes; null for none."""
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        return value[1:-1]
    return value if value not in ("", "~", "null") else None


def options(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of one options file, which is read whole."""
    body = "\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect())
    return spark.createDataFrame(list(parse(body).items()), "name string, value string")
