"""The facts of `intervals`, a file at once: the tokens of a text are cut in the JVM, and a Python function goes over them once,
with the brackets that are open. A file is one row, so nothing but files is dealt out, and a task holds the tokens of few files;
intervals.facts makes a row of each token and sorts these for each of its windows, to the same facts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwake.operators import intervals
from sparkwake.operators.intervals import ASIDE, DECLARE, FILE, LISTS, NO_CALL, NO_LITERAL, NO_NAME, OTHERWISE, TOKENS, language

#: How many brackets around a token are looked at; files that are Python objects at once.
AROUND, SLICE = len(intervals.AROUND), 256
ENV_CALL, ENV_INDEX = re.compile(intervals.ENV_CALL), re.compile(intervals.ENV_INDEX)
FACT = pa.schema([("repo_id", pa.string()), ("service", pa.string()), ("path", pa.string()), ("ordinal", pa.int32()), ("line", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("value", pa.string()), ("default", pa.string())])
PREFIX = re.compile(r"[rRbBfFuU@$]{0,2}(?=[\"'`])")
QUOTED = re.compile(r"\"\"\"(.*)\"\"\"|\'\'\'(.*)\'\'\'|\"(.*)\"|'(.*)'|`(.*)`", re.DOTALL)
BLANK, SPACE = " \t\n\x0b\f\r", re.compile(r"[ \t\n\x0b\f\r]")
NOTE, WORD, GENERIC, LAST = (re.compile(p, re.ASCII) for p in (r"@[A-Za-z_]", r"[A-Za-z_$]", r"<\s*(\w+)", r"(\w+)$"))
STUB, PROCESS_ENV = re.compile(r"(?:Client|Stub|Server|to_server)$"), re.compile(r"process\.env\.(\w+)", re.ASCII)
ASSIGNS, BASES = (":", "=>", "="), ("extends", "implements", ":")
SINCE = ("extends", "implements", "{", "}", ";", "(", ")", "=", "class", "interface")


def _value(token: str) -> str:
    """A string's content: prefix and quotes go."""
    plain = PREFIX.sub("", token, count=1) if PREFIX.match(token) else token
    found = QUOTED.fullmatch(plain)
    return next(g for g in found.groups() if g is not None) if found else plain


def _restored(token: str) -> str:
    for escape, mark in ASIDE:
        token = token.replace(mark, escape)
    return token


class Bracket:
    """Where it opens, which it is, the name before it, the word before that, a key before it, what follows its end (a text, and
    the string after that), the bracket around it, and whether it holds the arguments of a call or is a literal."""

    __slots__ = ("after", "after2", "before2", "call", "head", "key", "literal", "pos", "text", "up")

    def __init__(self, pos: int, text: str, head: str | None, before2: str | None, key: str | None, up: Bracket | None) -> None:
        self.pos, self.text, self.head, self.before2, self.key, self.up = pos, text, head, before2, key, up
        self.after = self.after2 = None

    def read(self, language: str) -> None:
        """A call's bracket has a name before it, and nothing is declared."""
        name, before = self.head, self.before2 or ""
        round_ = self.text == "(" and before not in DECLARE and (before == "new" or (self.after or "") not in ("{", "throws") or language in ("go", "python"))
        literal = self.text == "{" and language == "go" and before not in ("struct", "interface") and before not in DECLARE and before not in NO_LITERAL
        self.call = name is not None and name not in NO_CALL and name not in LISTS and not name.startswith("@") and (round_ or literal)
        self.literal = (self.text in ("{", "[") or self.head in LISTS) and not self.call


#: A token but white space and comments: its place among all, line, kind (string, name, note, open, close, mark), text, the
#: bracket that encloses it, its place among the parts that commas make of what the bracket holds, and the bracket that it opens.
Token = tuple[int, int, str, str, Bracket | None, int, Bracket | None]


def nested(raw: list[str], language: str) -> list[Token]:
    """The tokens of a file. The bracket that encloses a token is the last that has opened on the level above; of brackets of
    one level, the one after an opening one closes it."""
    kept, line = [], 1
    for pos, token in enumerate(raw):
        comment = token[:1] == "#" if language == "python" else token[:2] in ("//", "/*")
        if not comment and token[0] not in BLANK:
            if PREFIX.match(token):
                kind = "string"
            elif NOTE.match(token):
                kind = "note"
            else:
                kind = "open" if token[0] in "([{" else "close" if token[0] in ")]}" else "name" if WORD.match(token) else "mark"
            kept.append((pos, line, kind, SPACE.sub("", token) if kind in ("name", "note") else _restored(token) if kind == "string" or token > "~" else token))
        line += token.count("\n")
    level, commas, last, waiting, out, brackets = 0, {}, {}, {}, [], []
    for n, (pos, line, kind, text) in enumerate(kept):
        if kind == "close":
            level -= 1
            for bracket in waiting.pop(level, ()):
                bracket.after = kept[n + 1][3] if n + 1 < len(kept) else None
                bracket.after2 = kept[n + 2][3] if n + 2 < len(kept) and kept[n + 2][2] == "string" else None
        if text == ",":
            commas[level] = commas.get(level, 0) + 1
        up, since = last.get(level, (None, 0))
        own = None
        if kind == "open":
            before, before2 = (kept[n - k] if n >= k else (0, 0, None, None) for k in (1, 2))
            own = Bracket(pos, text, before[3] if before[2] in ("name", "note") else None, before2[3], before2[3] if before[3] in ASSIGNS else None, up)
            brackets.append(own)
            waiting.setdefault(level, []).append(own)
            last[level + 1] = own, commas.get(level + 1, 0)
        out.append((pos, line, kind, text, up, commas.get(level, 0) - since, own))
        if kind == "open":
            level += 1
    for bracket in brackets:
        bracket.read(language)
    return out


def _of_calls(rows: list[Token]) -> Iterator[tuple]:
    """Literal arguments, and look-ups of the environment by a call: a second argument, or a literal beyond an `or`, is the default."""
    calls: dict[Bracket, dict[int, list]] = {}
    for n, (pos, line, kind, text, up, arg, _) in enumerate(rows):
        if up is None or not up.call or (kind == "mark" and text == ","):
            continue
        # a keyword and its mark are no part of the value
        if (kind == "mark" and text in ASSIGNS) or (kind != "close" and n + 1 < len(rows) and rows[n + 1][3] in ASSIGNS):
            continue
        calls.setdefault(up, {}).setdefault(arg, []).append((pos, line, kind, text))
    for up, parts in calls.items():
        first = second = None
        for arg, held in sorted(parts.items()):
            strings = sum(h[2] == "string" for h in held)
            value = "".join(_value(t) if k == "string" else f"${{{t}}}" if k == "name" else "" for _, _, k, t in held)
            pos, line = held[0][0], held[0][1]
            if len(held) == 1 and strings == 1:
                kind = "call_template" if "${" in value or "#{" in value else "call"
            elif strings and any(h[3] == "+" for h in held):
                kind = "call_template"
            else:
                continue
            yield pos, line, kind, up.head, value, str(arg)
            if kind == "call" and arg == 0:
                first = pos, line, value
            elif kind == "call" and arg == 1:
                second = value
        if first and ENV_CALL.search(up.head):
            yield first[0], first[1], "env", first[2], None, second if second is not None else _beyond(up)


def _beyond(bracket: Bracket) -> str | None:
    return _value(bracket.after2) if bracket.after in OTHERWISE and bracket.after2 is not None else None


def _method(callee: str | None) -> str | None:
    if callee is None:
        return None
    found = LAST.search(callee.split("<", 1)[0])
    return found[1].lower() if found else ""


def _of_tokens(rows: list[Token], language: str, methods: frozenset[str]) -> Iterator[tuple]:
    since, none = None, (0, 0, None, None)
    padded = [none, none, *rows, none, none]
    for n, (pos, line, kind, text, up, _, bracket) in enumerate(rows):
        before2, before, _, after, after2 = padded[n : n + 5]
        base_of, is_key = since, after[3] in ASSIGNS and kind in ("name", "string")
        if text in SINCE or (text == ":" and before2[3] in ("class", "interface", "record")):
            since = text
        if kind == "open":
            if bracket.call:
                head, method = bracket.head, _method(bracket.head)
                if method in methods and (generic := GENERIC.search(head)):
                    yield pos, line, "event_type", "consumer" if "subscri" in method else "producer", generic[1], None
                if bracket.before2 == "new" and head.endswith("Event") and not head.endswith("DomainEvent"):
                    yield pos, line, "event_type", "producer", head, None
                if STUB.search(head.split("<", 1)[0]):
                    yield pos, line, "stub", head, None, None
            continue
        if kind not in ("name", "string"):
            continue
        around = []  # the brackets around it that are looked at
        while len(around) < AROUND:
            around.append(around[-1] and around[-1].up if around else up)
        note = next((b.head[1:] for b in around if b is not None and b.text == "(" and (b.head or "").startswith("@")), None)
        # the call of whose arguments a token is part, through literals
        callee, keyed, through = up.head if up is not None and up.call else None, [], True
        for inner, outer in zip(around, around[1:], strict=False):
            through = through and inner is not None and inner.literal
            if through:
                if callee is None and outer is not None and outer.call:
                    callee = outer.head
                keyed.insert(0, inner.key)
        if kind == "name":
            plain = not is_key and text not in NO_NAME
            if plain and callee is not None and after[3] != "(" and _method(callee) in methods:
                yield pos, line, "call_name", callee, text, None
            if plain and note is not None:
                yield pos, line, "annotation_name", note, text, None
            of_class = language == "python" and up is not None and up.text == "(" and up.before2 == "class"
            if plain and before[3] != "<" and (base_of in BASES or of_class) and text not in ("extends", "implements"):
                yield pos, line, "extends", text, after2[3] if after[3] == "<" else None, None
            if found := PROCESS_ENV.fullmatch(text):
                yield pos, line, "env", found[1], None, _value(after2[3]) if after[3] in OTHERWISE and after2[2] == "string" else None
            continue
        if not is_key and callee is not None:
            own_key = before2[3] if before[3] in ASSIGNS and before2[2] in ("name", "string") else None
            keys = re.sub("[\"'`]", "", ".".join(k for k in (*keyed, own_key) if k is not None))
            if keys != "" or (up is not None and up.literal):
                yield pos, line, "call_key", f"{callee}#{keys}", _value(text), None
        if not is_key and note is not None:
            yield pos, line, "annotation", note, _value(text), None
        if up is not None and up.text == "[" and up.head is not None and ENV_INDEX.search(up.head):
            yield pos, line, "env", _value(text), None, _beyond(up)


def facts(files: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """files (repo_id, service, path, text) -> the facts of intervals.facts."""
    known = files.select(*FILE, "service", language(F.col("path")).alias("language"), "text").where(F.col("language").isNotNull() & F.col("text").isNotNull())
    cut = {k: F.regexp_extract_all(intervals._text(F.col("text"), False), F.lit(p), F.lit(0)) for k, p in TOKENS.items()}
    every = F.when(F.col("language") == "python", cut["python"]).otherwise(cut["braced"])
    dealt = known.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, *FILE).select(*FILE, "service", "language", every.alias("raw"))
    wanted = frozenset(methods)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found: list[tuple] = []
                for repo, path, service, kind, raw in zip(*batch.slice(at, SLICE).to_pydict().values(), strict=True):
                    rows = nested(raw, kind)
                    found += [(repo, service, path, *f) for f in (*_of_calls(rows), *_of_tokens(rows, kind, wanted))]
                columns = zip(*found, strict=True) if found else [()] * len(FACT)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FACT, strict=True)], schema=FACT)

    return dealt.mapInArrow(run, "repo_id string, service string, path string, ordinal int, line int, kind string, name string, value string, default string")
