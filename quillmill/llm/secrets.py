"""Secret scans: three fixed patterns, and an assignment-aware lexer.

The lexer cuts every line that can hold an assignment into tokens, reads name-literal pairs from them (``name = "x"``,
``"name": "x"``, ``name: type = "x"``, ``conf["name"] = 'x'``, ``NAME=x``, ``name => 'x'``, ``put("name", "x")``,
``setName("x")``, ``<name>x</name>``, ``--name x``) and remembers what each name was given. A name on the right, also
within a sum of terms, stands for what it was given last above, or else first below; so a literal belongs to every
name that it reaches, over any number of steps. It is scored by the most sensitive of these names times how much it
looks like a secret rather than a word, a placeholder or a reference, and reported from a threshold on.

Each text is read whole by one task, by itself; nothing is shuffled. Time is linear in the text's length, broken
quotes included. Null and empty texts have no spans; repeated rows give repeated rows; a null id stays null. Columns
other than id and text are not read. Positions are code points, ends exclusive; fixed patterns are the whole match.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Kinds of spans in the order in which those with one start are listed.
KINDS = ("assign", "access", "hex", "lexed")

# Fixed patterns. A failing match of the first still uses up its characters, so its length is tested afterwards; for
# the other two a match is a maximal run, so the length can stand in the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

# Word lists: how sensitive a name's words make it.
STRONG = set("password passwd passphrase pwd secret token apikey credential credentials privatekey accesskey bearer".split())
MIDDLE = set("pass auth authorization pin cred creds signature salt nonce passcode dsn".split())
KEY_OF = set("api access private secret signing encryption auth account session master client storage shared service".split())
#: Words that make a name speak about a secret rather than hold one.
ABOUT = set(
    "name file path url uri id field label type length len size count expiry expires ttl hint regex pattern public title "
    "placeholder help description policy min max prompt text class header prefix suffix column param endpoint format".split()
)
PLACEHOLDERS = set(
    "password passwd secret token none null nil true false test example sample changeme change_me change-me default string "
    "required optional undefined redacted hidden todo tbd str int bool bytes value unknown empty dummy placeholder foobar".split()
)
REFERENCE = re.compile(r"\$\{?\w|\{\{|<[^<>]*>$|%\(?\w+\)?[s%]?$|@\{|(your|my|the|insert|enter|replace)[-_ ]|(.)\2*$", re.I)

NAME = re.compile(r"[^\W\d][\w$]*+(?:[.-][^\W\d][\w$]*+)*+")
TOKEN = re.compile(r"(?P<name>[^\W\d][\w$]*+(?:[.-][^\W\d][\w$]*+)*+)|(?P<op>:=|=>|::|[!<>~+*/%&|^?=]=+|[=:])|(?P<quote>[\"'`])|(?P<flag>--(?=[^\W\d]))|(?P<other>\S)")
CLOSE = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+") for q in "\"'`"}
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]++")
MARKUP = re.compile(r"<([^\W\d][\w.:-]*+)>([^<>\n]++)</")
GIVES = {"=", ":", ":=", "=>", "?="}
HINTS = ("=", ":", "--", '("', "('", '",', "',", "</")
LINE = re.compile(r"[^\n]++")
HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
WORD = re.compile(r"[^\W_]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def sensitivity(name: str) -> float:
    """How much a name says that its value is secret, from 0 to 1."""
    words = [w.lower() for part in WORD.findall(name) for w in HUMP.findall(part) or [part]]
    joined = set(words) | {a + b for a, b in zip(words, words[1:], strict=False)}
    if joined & STRONG or "key" in joined and joined & KEY_OF:
        score = 1.0
    elif joined & MIDDLE:
        score = 0.7
    else:
        score = 0.4 if "key" in joined else 0.0
    return score * (0.2 if words and words[-1] in ABOUT or "public" in joined else 1.0)


def secrecy(literal: str, quoted: bool) -> float:
    """How much a literal looks like a secret and not like a word, a placeholder or a reference, from 0 to 1."""
    if len(literal) < 6 or literal.lower() in PLACEHOLDERS or REFERENCE.match(literal):
        return 0.0
    if any(c.isspace() for c in literal):
        return 0.3
    kinds = sum(map(bool, (re.search(r"[a-z]", literal), re.search(r"[A-Z]", literal), re.search(r"\d", literal), re.search(r"[^\w]", literal))))
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    if kinds >= 2 and re.search(r"\d", literal) and bits >= 2.2:
        return 1.0
    if not quoted:
        return 0.0
    return 0.6 if kinds >= 2 and bits >= 2.2 or n >= 16 and bits >= 3 else 0.5


class Source:
    """The name-literal pairs of one text. Terms are (True, start, end, quoted) for a literal, (False, name) for a name."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.pairs: list[tuple[str, int, list[tuple]]] = []
        if any(h in text for h in HINTS):
            for line in LINE.finditer(text):
                if any(h in line[0] for h in HINTS):
                    self.line(line.start(), line.end())
            for m in MARKUP.finditer(text):
                self.pairs.append((m[1], m.start(), [(True, *m.span(2), True)]))

    def tokens(self, start: int, end: int) -> list[tuple[str, int, int]]:
        """(kind, start, end); a string's span is what stands between its quotes. A quote that never closes on its line
        is punctuation, and so are all later ones of its kind there."""
        out, at, dead = [], start, set()
        while m := TOKEN.search(self.text, at, end):
            at = m.end()
            if m.lastgroup == "quote" and m[0] not in dead:
                body = CLOSE[m[0]].match(self.text, at, end)
                if body.end() < end and self.text[body.end()] == m[0]:
                    out.append(("string", at, body.end()))
                    at = body.end() + 1
                    continue
                dead.add(m[0])
            out.append((m.lastgroup, *m.span()))
        return out

    def line(self, start: int, end: int) -> None:
        tokens, text = self.tokens(start, end), self.text
        said = lambda i: text[tokens[i][1] : tokens[i][2]] if 0 <= i < len(tokens) else ""
        kind = lambda i: tokens[i][0] if 0 <= i < len(tokens) else ""
        for i in range(len(tokens)):
            if kind(i) == "op" and said(i) in GIVES:
                j = i - 1
                if said(i) == "=" and kind(j) == "name" and said(j - 1) == ":" and kind(j - 2) == "name":
                    j -= 2  # name: type = value
                while said(j) in ("]", ")", "!", "?"):
                    j -= 1
                if kind(j) in ("name", "string") and not (said(i) == ":" and kind(i + 1) == "name" and said(i + 2) == "="):
                    self.give(j, tokens, self.terms(tokens, i + 1, tokens[i][2], end))
            elif kind(i) == "string" and said(i + 1) == "," and kind(i + 2) == "string" and NAME.fullmatch(said(i)):
                self.give(i, tokens, self.terms(tokens, i + 2, tokens[i + 2][1] - 1, end))
            elif kind(i) == "name" and said(i + 1) == "(" and kind(i + 2) == "string" and said(i + 3) == ")":
                self.give(i, tokens, [(True, *tokens[i + 2][1:], True)])
            elif kind(i) == "flag" and kind(i + 1) == "name" and kind(i + 2) in ("name", "other", "string") and said(i + 2) != "-":
                self.give(i + 1, tokens, self.terms(tokens, i + 2, tokens[i + 2][1] - (kind(i + 2) == "string"), end))

    def give(self, j: int, tokens: list[tuple[str, int, int]], terms: list[tuple]) -> None:
        if terms:
            _, start, end = tokens[j]
            self.pairs.append((self.text[start:end], start, terms))

    def terms(self, tokens: list[tuple[str, int, int]], i: int, at: int, end: int) -> list[tuple]:
        """The terms of a value that begins at token i: strings side by side or joined, names, or one bare word."""
        out, text = [], self.text
        while i < len(tokens):
            kind, start, stop = tokens[i]
            if kind == "string":
                out.append((True, start, stop, True))
            elif kind == "name" and i + 1 < len(tokens) and tokens[i + 1][0] == "string" and tokens[i + 1][1] == stop + 1 and stop - start <= 2:
                i += 1  # a string's prefix
                continue
            else:
                bare = BARE.match(text, start, end)
                if not bare:
                    break
                if NAME.fullmatch(bare[0]):
                    out.append((False, bare[0]))
                if not out or not out[-1][0]:
                    out.append((True, *bare.span(), False))
                while i + 1 < len(tokens) and tokens[i + 1][1] < bare.end():
                    i += 1
            i += 1
            if i < len(tokens) and text[tokens[i][1] : tokens[i][2]] in ("+", ".", "&", ".."):
                i += 1
            elif not (i < len(tokens) and tokens[i][0] == "string" and out[-1][0] and out[-1][3]):
                break
        return out

    def scored(self, threshold: float) -> list[tuple[int, int, str, float]]:
        """(start, end, name, score) of the literals that reach ``threshold``, each with its most sensitive name."""
        given: dict[str, list[int]] = {}
        for i, (name, _, _) in enumerate(self.pairs):
            given.setdefault(name, []).append(i)
        best: dict[tuple[int, int], tuple[float, str]] = {}
        for i, (name, _, _) in enumerate(self.pairs):
            if not (weight := sensitivity(name)):
                continue
            todo, seen = [i], {i}
            while todo:
                k = todo.pop()
                _, at, terms = self.pairs[k]
                reached = False
                for term in terms:
                    if term[0]:
                        if reached and not term[3]:
                            continue  # a word that names something else is no literal
                        score = weight * secrecy(self.text[term[1] : term[2]], term[3])
                        if score >= threshold and score > best.get(term[1:3], (0, ""))[0]:
                            best[term[1:3]] = (score, name)
                    elif places := given.get(term[1]):
                        above = [p for p in places if self.pairs[p][1] < at and p != k]
                        below = [p for p in places if self.pairs[p][1] > at]
                        reached = bool(above or below)
                        for p in (above[-1:] or below[:1]):
                            if p not in seen:
                                seen.add(p)
                                todo.append(p)
        return [(start, end, name, score) for (start, end), (score, name) in sorted(best.items())]


SPAN = "array<struct<kind:string,start:int,end:int,name:string,score:double>>"


def spans_of(text: str, threshold: float) -> list[tuple]:
    found = [(*s, None, 1.0) for s in base_spans(text)]
    found += [("lexed", start, end, name, score) for start, end, name, score in Source(text).scored(threshold)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, row_id: str = "doc_id", text: str = "text", threshold: float = 0.4) -> DataFrame:
    """Each row's id and spans: kind, start, end, the name that made a lexed span sensitive, and its score."""
    rows = docs.select(F.col(row_id).alias(row_id), F.coalesce(F.col(text).cast(StringType()), F.lit("")).alias("text_"))
    schema = f"`{row_id}` {rows.schema[row_id].dataType.simpleString()}, spans {SPAN}"
    fields = ("kind", "start", "end", "name", "score")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            spans = [[dict(zip(fields, s, strict=True)) for s in spans_of(t, threshold)] for t in part["text_"]]
            yield pd.DataFrame({row_id: part[row_id], "spans": pd.Series(spans, index=part.index, dtype=object)})

    return rows.mapInPandas(work, schema)


def digests(scanned: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Counts by kind, a digest of the fixed patterns' spans, and all spans as kind:start:end."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return scanned.select(
        row_id,
        *(count(k) for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
        count(KINDS[3]),
    )
