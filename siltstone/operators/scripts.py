"""Statements of inline scripts: cut where brackets are closed again, with the calls they make."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import parsed

# strings, comments, and single brackets and separators; what is between is taken as it is. No part is tried twice
_PART = re.compile(r"\"(?:[^\"\\\n]++|\\.)*+\"?|'(?:[^'\\\n]++|\\.)*+'?|`(?:[^`\\]++|\\.)*+`?|//[^\n]*+|/\*(?s:.*?)(?:\*/|\Z)|[(){}\[\];,]|[^\"'`/(){}\[\];,]++|/", re.DOTALL)
_CALL = re.compile(r"([A-Za-z_$][\w$.]*)\s*\(")
CLOSING = {")": "(", "]": "[", "}": "{"}


def statements(source: str) -> Iterator[tuple[str, str | None, int | None]]:
    """text, call and number of arguments of each statement of a script, in one pass.

    A statement ends at a semicolon, or after a closing brace, where no bracket is open; brackets in strings and comments don't count, and depth starts anew
    after each statement, so a bracket too many ends nothing but its own. Comments are left out. A statement that begins with a name and a bracket
    is a call of it; arguments are parted by commas at that bracket's own level.
    """
    text: list[str] = []
    # level: depth inside the first bracket of a call, while it is open; filled: something stands there
    first, depth, commas, level, filled, call, arguments = True, 0, 0, None, False, None, None

    def made() -> Iterator[tuple[str, str | None, int | None]]:
        whole = " ".join("".join(text).split())
        if whole:
            yield whole, call, arguments

    for found in _PART.finditer(source):
        part = found[0]
        if part.startswith(("//", "/*")):
            text.append(" ")
            continue
        if part == ";" and depth <= 0:
            yield from made()
            text, first, depth, commas, level, filled, call, arguments = [], True, 0, 0, None, False, None, None
            continue
        if part in "([{":
            depth += 1
            if first:
                head = _CALL.fullmatch("".join(text).strip() + part)
                if head:
                    call, level = head[1], depth
                first = False
            elif level is not None:
                filled = True
        elif part in CLOSING:
            if depth == level:
                arguments, level = commas + 1 if filled else 0, None
            depth -= 1
        elif part == "," and depth == level:
            commas += 1
        elif level is not None and part.strip():
            filled = True
        text.append(part)
        if part == "}" and depth <= 0:
            yield from made()
            text, first, depth, commas, level, filled, call, arguments = [], True, 0, 0, None, False, None, None
    yield from made()


def script_statements(pages: DataFrame) -> DataFrame:
    """page_id, place, text, call, arguments of the statements of each page's inline scripts, in order; data blocks of other types are no scripts. No shuffle; null html has none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [e for e in parsed(html).elements if e.tag == "script" and "src" not in e.attributes and e.attributes.get("type", "").lower() in ("", "module", "text/javascript")]
                rows += [(page_id, k, *s) for k, s in enumerate(s for e in own for s in statements(e.text))]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "place", "text", "call", "arguments"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(read, "page_id long, place int, text string, call string, arguments int")
