"""Secrets by three fixed patterns and by lexing assignments.

The lexer reads source and configuration syntax into name-literal pairs (`name = "x"`,
`"name": 'x'`, `name := x`, `name: str = x`, `<name>x</name>`, `setName("x")`, `put("name", "x")`,
block scalars, triple and prefixed strings, fields in strings, strings and names joined by `+`;
`#define NAME "x"`, `--name x`, `a, b = "x", "y"`, defaults and alternatives as in
`getenv("X", "x")`, `v or "x"`, `c ? "x" : "y"`, and entries of a name and a value as in
`name: N, value: x`), takes passwords of URLs and credentials of Authorization headers, follows names back to their literals wherever these stand in the text, and scores each literal by
how sensitive the name is that it reaches and by the look of the whole value.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import text

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")
#: How sensitive a part of a name is.
PARTS = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "private": 0.6, "bearer": 0.8, "authorization": 0.9, "key": 0.4}
#: Names that end so tell something about a secret and hold none.
ABOUT = {"hint", "santa", "policy", "length", "len", "size", "field", "label", "file", "path", "dir", "url", "uri", "endpoint", "type", "count", "prompt", "placeholder", "message", "msg", "error", "expiry", "expires", "ttl", "limit", "regex", "pattern", "format", "algorithm", "question"}
#: Words of sentences; a passphrase has none.
_SENTENCE = {"a", "an", "the", "is", "are", "be", "must", "of", "for", "to", "at", "in", "your", "you", "not", "no", "and", "or", "with", "please", "enter", "this", "that"}
_HINTS = tuple(p.encode() for p in ("pass", "pwd", "secret", "token", "apikey", "credential", "auth", "private", "bearer", "key"))
_IDENTIFIER = r"[A-Za-z_$][\w$.]*+"
_GAP = r"[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?"
_QUOTED = "|".join([r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""', r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''", r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)*+'", r"`[^`\n]*+`"])
_STRING = rf"(?:[rRbBuUfF]{{1,2}}|[@$]{{1,2}})?(?:{_QUOTED})"
#: Strings joined by + or by standing side by side, and names among them.
_JOINED = rf"""(?:{_IDENTIFIER}{_GAP}\+{_GAP})*+{_STRING}(?:{_GAP}\+{_GAP}(?:{_STRING}|{_IDENTIFIER})|[\x20\t]+(?=["']){_STRING})*+"""
_PLAIN = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
_COMMENT = r"(?:/\*[^*/\n]*+\*/[\x20\t]*)?"
_TYPE = r"&?(?:'\w+[\x20\t]+)?[A-Za-z_][\w.]*+(?:\[[\w.,|\x20]*+\])?(?:[\x20\t]*\|[\x20\t]*\w++)*+"
_ASSIGNED = rf"""(?:["'`]?\]?|["'])[\x20\t]*{_COMMENT}(?::[\x20\t]*{_TYPE}[\x20\t]+=(?=[\x20\t])|:=|=>|->|=(?![=~>])|:(?!:))[\x20\t]*{_COMMENT}(?:[(\[][\x20\t]*(?=["']))?"""
PAIR = re.compile(
    rf"""(?<![\w$.-])(?P<name>[A-Za-z_$][\w$.-]*+)(?:{_ASSIGNED}(?:(?P<joined>{_JOINED})|(?P<block>[|>][-+0-9]{{0,2}})[\x20\t]*\r?\n|(?P<bare>[^\s"'`,;\#(){{}}\[\]<>]+))"""
    rf"""|[\x20\t]+(?P<spaced>{_PLAIN})|\([\x20\t]*(?:["'](?P<key>[\w$.-]++)["'][\x20\t]*,[\x20\t]*)?(?P<passed>{_JOINED})[\x20\t]*[),])|<(?P<tag>[A-Za-z_][\w.-]*)>(?P<inner>[^<>\n]+)</(?P=tag)>"""
    rf"""|(?<![^\s"'\[,])--?(?P<flag>[A-Za-z][\w-]*+)(?:=|[\x20\t]++)(?:(?P<quoted>{_PLAIN})|(?P<word>[^\s"'`;,]+))""",
    re.A,
)
#: Several names that take several strings, from a line's first name on.
_TUPLE = re.compile(rf"""^[\x20\t]*+(?:(?:let|const|var|my|local)[\x20\t]++)?\(?(?P<names>{_IDENTIFIER}(?:[\x20\t]*+,[\x20\t]*+{_IDENTIFIER})++)\)?[\x20\t]*+:?=[\x20\t]*+\(?(?P<values>{_PLAIN}(?:[\x20\t]*+,[\x20\t]*+{_PLAIN})++)""", re.A | re.M)
#: Strings that a name may take instead of the value before them.
_OTHERWISE = re.compile(
    rf"""(?:\belse|\bor|\?\?|\|\|)[\x20\t]*+(?P<a>{_PLAIN})|\?[\x20\t]*+(?P<b>{_PLAIN})[\x20\t]*+:[\x20\t]*+(?P<c>{_PLAIN})"""
    rf"""|(?:getenv|env|get|getProperty|getOrDefault|fetch|config)\([\x20\t]*+{_PLAIN}[\x20\t]*+,[\x20\t]*+(?P<d>{_PLAIN})|\bunwrap_or\((?P<e>{_PLAIN})""",
    re.A,
)
_LINE_END = re.compile(r"[\n;]|\Z")
_ENTRY = re.compile(rf"""["']?\b(?:key|name)["']?[\x20\t]*+[:=][\x20\t]*+["']?(?P<name>[A-Za-z_][\w.-]*+)["']?[\s,]*+["']?value["']?[\x20\t]*+[:=][\x20\t]*+(?:(?P<quoted>{_PLAIN})|(?P<word>[^\s"'`;,<>{{}}]+))""", re.A)
_URL = re.compile(r"""://[^\s:/@"'<>]*+:(?P<word>[^\s/@"'<>]++)@""")
_HEADER = re.compile(r"""\b(?P<name>Authorization)["']?[\x20\t]*+[:=,][\x20\t]*+["']?(?:Bearer|Basic|Token)\x20++(?P<word>[\w+/=.~-]{6,})""", re.I | re.A)
_TERM = re.compile(rf"(?P<string>{_STRING})|(?P<name>{_IDENTIFIER})", re.A)
_NAMED = re.compile(r"\$\{([A-Za-z_]\w*)\}", re.A)
_FIELD = re.compile(r"\$?\{([A-Za-z_][\w.]*+)[^{}\n]*+\}", re.A)
#: First words of functions whose argument becomes the value of what they are named after.
SETTERS = {"set", "with", "use", "put", "add"}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_WHOLE_NAME = re.compile(r"[A-Za-z_$][\w$.]*|\$\{[A-Za-z_]\w*\}", re.A)
_DUMMY = re.compile(r"(?i)^(?:\$|%|<|\{|x{4}|\*{3})|example|changeme|placeholder|your[_-]|dummy|^(?:none|null|true|false|undefined)$|os\.environ|getenv|process\.env")


def name_score(name: str) -> float:
    """How sensitive a name is: its most sensitive part, of two that make a pair (api key, private key) their sum."""
    parts = [p.lower() for p in _WORD.findall(name.rpartition(".")[2] or name)]
    found = [PARTS[p] for p in parts if p in PARTS]
    if not found or next(p for p in reversed(parts) if not p.isdigit()) in ABOUT:
        return 0.0
    if "key" in parts and {"api", "access", "private", "secret", "signing", "encryption", "auth"} & set(parts):
        return 1.0
    return max(found)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length and spread of its characters."""
    return _spread(Counter(value)) if _plausible(value) else 0.0


def _plausible(value: str) -> bool:
    return bool(value) and not _DUMMY.search(value) and not any(c.isspace() for c in value)


def _passphrase(name: str, value: str) -> bool:
    """Is it four or more words, none of a sentence, under the name of a password?"""
    words = value.split()
    return len(words) >= 4 and name_score(name) >= 0.7 and all(w.replace("-", "").isalnum() for w in words) and not _SENTENCE & {w.lower() for w in words} and not _DUMMY.search(value)


def _telling(word: str) -> bool:
    """Is a bare word after a flag a value, and not the next word of a sentence, a path or a variable?"""
    return word[0].isalnum() and (any(c.isdigit() for c in word) or not word.isalnum()) and not word.startswith(("http:", "https:"))


def _spread(counts: Counter) -> float:
    n = sum(counts.values())
    if n < 6:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    return min(1.0, n / 12) * min(1.0, bits / 2.5)


class _Pair:
    """A name and what it is given: spans of literals, and other pairs whose names stand there."""

    __slots__ = ("name", "spans", "names", "uses", "counts", "best")

    def __init__(self, name: str):
        self.name, self.spans, self.names, self.uses, self.counts, self.best = name, [], [], [], None, (0.0, "")

    def take(self, t: str, a: int, b: int) -> None:
        """The literal at t[a:b], without white space around it."""
        value = t[a:b]
        a += len(value) - len(value.lstrip())
        if _plausible(value.strip()) or _passphrase(self.name, value):
            self.spans.append((a, a + len(value.strip())))

    def take_string(self, t: str, a: int, b: int) -> None:
        """A string with its prefix and quotes: the text between its fields, and the names in them."""
        q = a
        while t[q] not in "\"'`":
            q += 1
        width = 3 if t[q : q + 3] in ('"""', "'''") and b - q >= 6 else 1
        field, at, end = _FIELD if t[q] == "`" or set(t[a:q]) & set("fF$") else _NAMED, q + width, b - width
        for m in field.finditer(t, at, end):
            self.take(t, at, m.start())
            self.names.append(m[1])
            at = m.end()
        self.take(t, at, end)

    def take_joined(self, t: str, a: int, b: int) -> None:
        for m in _TERM.finditer(t, a, b):
            if m["string"]:
                self.take_string(t, *m.span())
            else:
                self.names.append(m["name"])


def _block(t: str, key: int, at: int) -> tuple[list[tuple[int, int]], int]:
    """Lines from at on that are empty or indented deeper than the line of key, and where they end."""
    line = t.rfind("\n", 0, key) + 1
    depth, lines = re.compile(r"[\x20\t]*").match(t, line).end() - line, []
    while at < len(t):
        end = t.find("\n", at)
        end = len(t) if end < 0 else end
        first = re.compile(r"[\x20\t\r]*").match(t, at, end).end()
        if first < end and first - at <= depth:
            break
        lines.append((first, end))
        at = end + 1
    return lines, at


def _apart(t: str) -> list[_Pair]:
    """Pairs whose name and value do not stand on two sides of one sign: entries, URLs and headers."""
    pairs = []
    for pattern in (_ENTRY, _HEADER, _URL):
        for m in pattern.finditer(t):
            groups = m.groupdict()
            pair = _Pair(groups.get("name") or "password")
            if groups.get("quoted"):
                pair.take_string(t, *m.span("quoted"))
            elif groups["word"].lower() not in PARTS:
                pair.take(t, *m.span("word"))
            pairs.append(pair)
    return pairs


def _pairs(t: str) -> list[_Pair]:
    """All pairs in order. A name in a value means its last pair before, or else its first one after."""
    pairs, last, first, later = [], {}, {}, []
    several = {}  # by the start of the last name
    for m in _TUPLE.finditer(t):
        names = list(re.finditer(_IDENTIFIER, m["names"], re.A))
        several[m.start("names") + names[-1].start()] = (m, [n[0] for n in names])
    at = looked = line_end = 0
    while m := PAIR.search(t, at):
        at, name, bare = m.end(), m["name"] or m["tag"] or m["flag"], m["bare"]
        if m["name"] and m.start("name") in several:
            whole, names = several[m.start("name")]
            at, begin = whole.end(), whole.start("values")
            for name, v in zip(names, re.finditer(_PLAIN, whole["values"])):
                pairs.append(pair := _Pair(name))
                pair.take_string(t, begin + v.start(), begin + v.end())
                last[name] = pair
                first.setdefault(name, pair)
            continue
        if m["flag"] or m["spaced"]:
            if name_score(name) < 0.7:
                at = m.end("flag") if m["flag"] else m.end("name")
                continue
            pairs.append(pair := _Pair(name))
            if m["word"]:
                if _telling(m["word"]):
                    pair.take(t, *m.span("word"))
            else:
                pair.take_string(t, *m.span("quoted" if m["flag"] else "spaced"))
            if m["spaced"]:
                last[name] = pair
                first.setdefault(name, pair)
            continue
        if m["passed"]:
            called = name.rpartition(".")[2]
            words = [w.lower() for w in _WORD.findall(called)]
            name = m["key"] or (called if words and (words[0] in SETTERS or words[0] in PARTS) else None)
            if not name:  # not a setter; its arguments may hold pairs
                at = m.end("name")
                continue
        pair = _Pair(name)
        if m["tag"]:
            pair.take(t, *m.span("inner"))
        elif m["passed"]:
            pair.take_joined(t, *m.span("passed"))
        elif m["joined"]:
            pair.take_joined(t, *m.span("joined"))
        elif m["block"]:
            if name_score(name):
                lines, at = _block(t, m.start(), at)
                for line in lines:
                    pair.take(t, *line)
        elif _WHOLE_NAME.fullmatch(bare):
            pair.names.append(bare.strip("${}") if bare.startswith("${") else bare)
        else:
            pair.take(t, *m.span("bare"))
        others = False
        if (bare or m["joined"]) and name_score(name):
            # the rest of a line is looked at once, for its first sensitive name
            if line_end < at:
                line_end = _LINE_END.search(t, at).start()
            for o in _OTHERWISE.finditer(t, max(looked, m.start("bare" if bare else "joined")), line_end):
                others = True
                for g in "abcde":
                    if o[g]:
                        pair.take_string(t, *o.span(g))
            looked = max(looked, line_end)
        missing = []
        for n in dict.fromkeys(pair.names):
            pair.uses.append(last[n]) if n in last else missing.append(n)
        if missing:
            # a call, an element or a name beside a string is no value of its own
            own = m.span("bare") if bare and not others and not bare.startswith("${") and t[m.end() : m.end() + 1] not in ("(", "[") else None
            later.append((pair, missing, own))
        pairs.append(pair)
        if not m["passed"]:
            last[name] = pair
            first.setdefault(name, pair)
    for pair, missing, own in later:
        found = [first[n] for n in missing if n in first and first[n] is not pair]
        pair.uses += found
        if own and not found:
            pair.take(t, *own)
    return pairs + _apart(t)


def lexed(t: str, threshold: float = 0.5) -> list[tuple[int, int, float, str]]:
    """(start, end, score, name) of each literal that reaches a sensitive name, in order."""
    pairs = _pairs(t)
    users = Counter(id(u) for p in pairs for u in p.uses)
    # users before what they use; of names given in a circle, those left over go last, in order
    order, seen = [p for p in pairs if not users[id(p)]], set()
    for p in order:
        seen.add(id(p))
        for u in p.uses:
            users[id(u)] -= 1
            if not users[id(u)]:
                order.append(u)
    order += [p for p in pairs if id(p) not in seen]
    for p in reversed(order):
        p.counts = Counter("".join(t[a:b] for a, b in p.spans))
        for u in p.uses:
            if u.counts is not None and sum(u.counts.values()) < 1 << 40:  # more no longer changes the score
                p.counts.update(u.counts)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for p in order:
        weight = name_score(p.name)
        if weight and (score := weight * _spread(p.counts)) >= threshold:
            p.best = max(p.best, (score, p.name))
        if p.best[0]:
            for u in p.uses:
                u.best = max(u.best, p.best)
            for x in p.spans:
                best[x] = max(best.get(x, (0.0, "")), p.best)
    return [(*x, *best[x]) for x in sorted(best)]


def secrets(raw: bytes, threshold: float = 0.5) -> list[dict]:
    """Spans in code points, by start and then kind."""
    low, found, t = raw.lower(), [], None
    hint = any(h in low for h in _HINTS) or (b"://" in low and b"@" in low)
    if hint:
        t = raw.decode()
        found = [("assign", *m.span(), 1.0, m[1]) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        t = t or raw.decode()
        found += [("access", *m.span(), 1.0, None) for m in ACCESS.finditer(t)]
    t = t if t is not None else raw.decode()
    found += [("hex", *m.span(), 1.0, None) for m in HEX.finditer(t)]
    if hint:
        base = sorted((a, b) for _, a, b, _, _ in found)
        starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        for a, b, s, n in lexed(t, threshold):
            before = bisect_left(starts, b)  # base spans that start before its end
            if not before or reach[before - 1] <= a:
                found.append(("literal", a, b, s, n))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return [dict(zip(("kind", "start", "end", "score", "name"), x)) for x in found]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("name", pa.string())])


def scan(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, score, name); a row for each row of docs.

    Null and empty texts have no spans. Whole texts are read, however long; repeated rows and null
    ids stay as they are; other columns are not read; an empty table gives an empty table.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), pa.array([secrets(t, threshold) for t in text.as_bytes(part.column("text"))], pa.list_(_SPAN))], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scanned, "doc_id long, spans array<struct<kind string, start long, end long, score double, name string>>")


def digest(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
