"""Texts of any size as ordered, bounded parts: written from pieces, read back as a stream of leaves.

A long text (a stored document, an explanation, a list of ids) never becomes one row. It is made
of pieces, one row each, that know their order; a running byte total inside the key cuts them into
parts of about ``PART_BYTES``, and the concatenation of a key's parts in order is the text. Reading
back, a task walks the parts of a key in order with a JSON tokenizer that holds one nesting
path, and returns every leaf as a row; a long string comes in chunks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import drop_stash, stash
from .ordered import gathered, totals_within

PART_BYTES = 1 << 20
CHUNK_CHARS = 1 << 16


def json_text(c: Column) -> Column:
    """One value as JSON text, strings quoted."""
    whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def json_inner(c: Column) -> Column:
    """A string as the inside of a JSON string, without the quotes."""
    quoted = json_text(c)
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def piece(df: DataFrame, keys: list[str], order: dict[str, Column], text: Column, between: str | None = None,
          opens: bool = False) -> DataFrame:
    """Pieces of one kind. ``between`` goes before the text unless the piece before ``opens`` a list."""
    return df.select(*keys, *[value.alias(name) for name, value in order.items()], text.alias("text"),
                     F.lit(between).cast("string").alias("between"), F.lit(opens).alias("opens"))


def cut(pieces: DataFrame, keys: list[str], order: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """(keys, part_no, payload) of :func:`piece` rows, which ``order`` orders totally inside a key.

    A piece goes to the part in which it starts, so a part holds at most ``part_bytes`` and one
    piece; numbers of parts rise but may skip when a piece is longer than a part. Keys are not null.
    The parts are written once, so those who read them again make nothing anew.
    """
    size = F.greatest(F.lit(1), F.octet_length("text") + F.coalesce(F.octet_length("between"), F.lit(0)))
    placed = totals_within(pieces, keys, order, {"_at": F.lit(1), "_start": size}, {"_first": "opens"})
    first = F.coalesce("_first", F.lit(False))
    glued = placed.select(*keys, "_at", F.expr(f"_start div {part_bytes}").alias("part_no"), F.when(
        ~first & F.col("between").isNotNull(), F.concat("between", "text")).otherwise(F.col("text")).alias("_t"))
    out = stash(glued.groupBy(*keys, "part_no").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda p: p["_t"]), "").alias("payload")))
    drop_stash(placed)
    return out


_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_WHOLE_ESCAPES = re.compile(r'[^"\\]*(?:\\(?:u[0-9a-fA-F]{4}|[^u])[^"\\]*)*', re.S)
_LITERAL = re.compile(r'[^\s{}\[\],:"]+')
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?\Z")
_SPACE = re.compile(r"[ \t\n\r]*")


class _Fields(list):
    """An object as its (name, value) pairs, repeated names too."""


class _Number(str):
    """A number as it is written."""


def _no_constant(word: str):
    raise ValueError(word)


_WHOLE = json.JSONDecoder(object_pairs_hook=_Fields, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
# Objects and lists that turn out to reach over the end of the text at hand, before no more are tried in it.
_TRIES = 16
_FED_CHARS = 1 << 18


class Walker:
    """Leaves of one JSON document that arrives in pieces; memory follows nesting and ``chunk``."""

    def __init__(self, chunk: int = CHUNK_CHARS):
        self.chunk, self.text, self.frames, self.expect, self.inside, self.failed = chunk, "", [], "value", False, False
        self.leaf = self.part = self.tries = 0
        self.held = ""  # of a string's value, less than a chunk

    def _row(self, kind: str, value: str | None, more: bool = False):
        path = "".join(("[]" if key is None else f".{key}") for key, _ in self.frames).lstrip(".")
        at = [n for key, n in self.frames if key is None]
        row = (self.leaf, self.part, path, at, kind, value)
        self.leaf, self.part = (self.leaf, self.part + 1) if more else (self.leaf + 1, 0)
        return row

    def _done(self):
        """After a value: what may follow."""
        self.expect = "more" if self.frames else "end"

    def feed(self, text: str, last: bool = False) -> Iterator[tuple]:
        """Rows (leaf, chunk_no, path, at, kind, value) that ``text`` completes."""
        self.text += text
        at = self.tries = 0
        while not self.failed:
            if self.inside:
                end = _STRING.match(self.text, at)
                stop = end.end() if end else _WHOLE_ESCAPES.match(self.text, at).end()
                raw = self.text[at:stop - 1] if end else self.text[at:stop]
                if not end and re.search(r"\\u[dD][89abAB]..\Z", raw):  # half of a character
                    raw, stop = raw[:-6], stop - 6
                if end or len(raw) >= self.chunk:
                    yield from self._string(raw, bool(end))
                    at = stop
                    if end:
                        self.inside = False
                        self._done()
                        continue
                break
            at = _SPACE.match(self.text, at).end()
            if at == len(self.text):
                break
            step = self._token(at, last)
            if step is None:
                break
            at, rows = step
            yield from rows
        self.text = self.text[at:]
        if last and not self.failed and (self.frames or self.expect != "end" or self.text.strip()):
            self.failed = True
        if self.failed and self.text is not None:
            yield self._row("error", None)
            self.text, self.failed = "", True
            self.feed = lambda *_: iter(())

    def _string(self, raw: str, end: bool):
        try:
            value = json.loads(f'"{raw}"')
            value.encode()
        except ValueError:
            self.failed = True
            return
        # Every chunk but the last is full, however the text was cut into parts.
        value, at = self.held + value, 0
        while len(value) - at > self.chunk:
            yield self._row("string", value[at:at + self.chunk], True)
            at += self.chunk
        self.held = "" if end else value[at:]
        if end:
            yield self._row("string", value[at:])

    def _whole(self, at: int):
        """End and rows of an object or list that lies whole in the text; None leaves it to be walked token by token."""
        try:
            value, end = _WHOLE.raw_decode(self.text, at)
            raw = self.text[at:end]
            if "\\u" in raw:  # may be half of a character
                return None
            raw.encode()
            rows = []
            prefix = "".join("[]" if key is None else f".{key}" for key, _ in self.frames)
            leaf = self._leaves(value, prefix, [n for key, n in self.frames if key is None], self.leaf, rows)
        except (ValueError, RecursionError):
            self.tries += 1
            return None
        self.leaf = leaf
        self._done()
        return end, rows

    def _leaves(self, value, prefix: str, at: list[int], leaf: int, rows: list[tuple]) -> int:
        """Appends the rows of a value; returns the number of the next leaf."""
        path, part = prefix.lstrip("."), 0
        if isinstance(value, _Fields):
            rows.append((leaf, 0, path, at, "object", None))
            leaf += 1
            for name, inner in value:
                leaf = self._leaves(inner, f"{prefix}.{name}", at, leaf, rows)
            return leaf
        if isinstance(value, list):
            rows.append((leaf, 0, path, at, "array", None))
            leaf += 1
            for n, inner in enumerate(value):
                leaf = self._leaves(inner, prefix + "[]", [*at, n], leaf, rows)
            return leaf
        if isinstance(value, _Number):
            rows.append((leaf, 0, path, at, "number", str(value)))
        elif isinstance(value, str):
            while len(value) > self.chunk:
                rows.append((leaf, part, path, at, "string", value[:self.chunk]))
                value, part = value[self.chunk:], part + 1
            rows.append((leaf, part, path, at, "string", value))
        elif value is None:
            rows.append((leaf, 0, path, at, "null", "null"))
        else:
            rows.append((leaf, 0, path, at, "boolean", "true" if value else "false"))
        return leaf + 1

    def _token(self, at: int, last: bool):
        sign, rows = self.text[at], []
        if self.expect in ("key", "first key") and sign == '"':
            end = _STRING.match(self.text, at + 1)
            if not end:
                return None
            try:
                name = json.loads(self.text[at:end.end()])
                name.encode()
            except ValueError:
                self.failed = True
                return at, rows
            self.frames[-1] = (name, 0)
            self.expect = ":"
            return end.end(), rows
        if sign == "}" and self.frames and self.frames[-1][0] is not None and self.expect in ("first key", "more") or (
                sign == "]" and self.frames and self.frames[-1][0] is None and self.expect in ("first value", "more")):
            self.frames.pop()
            self._done()
            return at + 1, rows
        if sign == ":" and self.expect == ":":
            self.expect = "value"
            return at + 1, rows
        if sign == "," and self.expect == "more":
            key, n = self.frames[-1]
            self.frames[-1] = (key, n + 1)
            self.expect = "value" if key is None else "key"
            return at + 1, rows
        if self.expect in ("value", "first value"):
            if sign in "{[":
                whole = self._whole(at) if self.tries < _TRIES else None
                if whole:
                    return whole
                rows.append(self._row("object" if sign == "{" else "array", None))
                self.frames.append(("", 0) if sign == "{" else (None, 0))
                self.expect = "first key" if sign == "{" else "first value"
                return at + 1, rows
            if sign == '"':
                self.inside = True
                return at + 1, rows
            found = _LITERAL.match(self.text, at)
            if found and (found.end() < len(self.text) or last):
                word = found[0]
                kind = {"true": "boolean", "false": "boolean", "null": "null"}.get(word, "number" if _NUMBER.match(word) else None)
                if kind:
                    rows.append(self._row(kind, word))
                    self._done()
                    return found.end(), rows
            elif found:
                return None
        self.failed = True
        return at, rows


def leaves(parts: DataFrame, key: str = "analysis_id", chunk: int = CHUNK_CHARS, paths: Sequence[str] | None = None) -> DataFrame:
    """(key, leaf, chunk_no, path, at, kind, value): every value of each key's document, in order.

    ``path`` names fields with dots and ``[]`` for list elements, whose positions are in ``at``;
    ``kind`` is object, array (no value), string, number, boolean, null or error (the text is
    not JSON; nothing of it follows). ``parts``: key, part_no, payload. With ``paths`` only the
    values there leave the task, beside errors and the first value under each top-level name.
    """
    wanted = None if paths is None else frozenset(paths)
    names = [key, "leaf", "chunk_no", "path", "at", "kind", "value"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.string()]

    def fed(batch):
        """Neighbouring parts of a key together, so that more of its values are whole."""
        owner, held, size = None, [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (key != owner or size >= _FED_CHARS):
                yield owner, "".join(held)
                held, size = [], 0
            owner = key
            held.append(text or "")
            size += len(held[-1])
        if held:
            yield owner, "".join(held)

    def chosen(owner, rows, seen):
        """The rows to send, and the top-level name of the last one."""
        if wanted is None:
            return [(owner, *r) for r in rows], seen
        out = []
        for r in rows:
            path = r[2]
            top = path.partition(".")[0].partition("[")[0]
            if top != seen or path in wanted or r[4] == "error":
                seen = top
                out.append((owner, *r))
        return out, seen

    def walk(batches):
        walker = now = seen = None
        for batch in batches:
            for owner, text in fed(batch):
                out = []
                if walker is None or owner != now:
                    out += chosen(now, walker.feed("", True), seen)[0] if walker else []
                    walker, now, seen = Walker(chunk), owner, None
                told, seen = chosen(now, walker.feed(text), seen)
                out += told
                for start in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out[start:start + 10_000]), types)], names=names)
        if walker:
            out, _ = chosen(now, walker.feed("", True), seen)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    # Told how many, Spark does not put keys together whose texts are small beside the work on them.
    tasks = 8 * parts.sparkSession.sparkContext.defaultParallelism
    ordered = gathered(parts.select(F.col(key).cast("string").alias(key), "part_no", "payload"), [key], ["part_no"], tasks)
    return ordered.select(key, "payload").mapInArrow(
        walk, f"{key} string, leaf bigint, chunk_no bigint, path string, at array<bigint>, kind string, value string")
