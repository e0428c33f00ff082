"""Secrets in texts: fixed shapes, and literals that reach a sensitive name through assignments."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with the same start are listed; ``named`` is what assignments add.
KINDS = ("assign", "access", "hex", "named")
# Fixed shapes.  Letters of the names in either case, ASCII only.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LENGTH = 8

# Assignments of source and configuration files: a plain, dotted or quoted name, maybe with a subscript, then a sign.
# Names begin where no longer name could, and nothing is given back once it is read, so a search is linear.
_NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]*+"
_TARGET = re.compile(rf"""(?<![A-Za-z0-9_$.])(?<![A-Za-z0-9_$]-)
    (?: (["'`]) (?P<quoted>{_NAME}) \1 [\x20\t]*+ \]?  |  (?P<plain>{_NAME}) (?: [\x20\t]*+ \[ [A-Za-z0-9_]*+ \] )? )
    [\x20\t]*+ (?P<sign> := | => | =(?![=>~]) | :(?![:/=]) ) [\x20\t]*+""", re.VERBOSE)
# A type between a colon and the sign of the value.
_TYPE = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\[\]\n=]*+(?:\[[^\[\]\n=]*+\][^\[\]\n=]*+)*+\])?[?*&]?(?:[\x20\t]*+\|[\x20\t]*+[A-Za-z_][A-Za-z0-9_.]*+)*+[\x20\t]*+=(?![=>~])[\x20\t]*+")
_STRING = re.compile(r"""(?:[fFrRbBuU]{1,2}(?=["']))?(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)""")
_TRIPLE = re.compile(r"""[fFrRbBuU]{0,2}(\"{3}|'{3})""")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#|]+""")
_NAME_ONLY = re.compile(rf"{_NAME}\Z")
_CALL = re.compile(rf"(?:new[\x20\t]++)?({_NAME})\(")
_BLANKS, _GAPS = re.compile(r"[\x20\t]*+"), re.compile(r"(?:\s|\\\n)*+")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Elements and attributes of markup.
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*>")
_TAG = re.compile(r"<[A-Za-z][^<>]*+>")
_ATTRIBUTE = re.compile(r"""([\w:.-]++)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
# Functions whose text arguments are names of settings, not values.
_LOOKUPS = {"getenv", "env", "environ", "get", "getproperty", "config", "lookup", "input", "getpass", "prompt"}
#: Words of a quoted value from which it is taken for a sentence instead of a pass phrase.
SENTENCE_WORDS = 7

# How sensitive words of a target name are, alone or side by side.
_SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
              "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.7,
              "api key": 1.0, "access key": 1.0, "secret key": 1.0, "private key": 1.0, "signing key": 0.9,
              "encryption key": 0.9, "client secret": 1.0, "connection string": 0.8}
# Words that make a name one about secrets rather than of one.
_ABOUT = {"count", "length", "limit", "max", "min", "type", "name", "field", "label", "hint", "path", "file", "url",
          "policy", "expiry", "ttl", "timeout", "size", "number"}
_PLACEHOLDER = re.compile(r"\A(?:x+|\*+|\.+|none|null|nil|true|false|todo|changeme|change_me|example|placeholder|"
                          r"dummy|redacted|your[_-].*|my[_-].*|<.*>|\$\{.*\}|\$\w+|%\w+%|\{\{.*\}\}|env[.:].*)\Z",
                          re.IGNORECASE)
THRESHOLD = 0.5


def name_score(name: str) -> float:
    """0 to 1: how much a target name speaks for a secret; its parts are words of camel, snake or dotted case."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    score = max([_SENSITIVE.get(w, 0.0) for w in parts + [f"{a} {b}" for a, b in zip(parts, parts[1:])]], default=0.0)
    return 0.0 if parts and parts[-1] in _ABOUT else score


def literal_score(value: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like a secret: length, mix of characters, bits per character.

    Only a quoted value may hold blanks; one of few words counts as a pass phrase.
    """
    words = value.split()
    if len(value) < 6 or _PLACEHOLDER.match(value) or not words or len(words) > 1 and (not quoted or len(words) >= SENTENCE_WORDS):
        return 0.0
    kinds = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value),
                           re.search("[^A-Za-z0-9]", value))))
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    score = 0.25 * min(n / 12, 1) + 0.25 * min((kinds - 1) / 2, 1) + 0.3 * min(bits / 3.2, 1)
    return (score + (0.2 if quoted else 0.0)) * (0.8 if len(words) > 1 else 1.0)


@dataclass(frozen=True)
class Literal:
    value: str
    start: int
    end: int
    quoted: bool


@dataclass(frozen=True)
class Assignment:
    name: str
    literals: tuple[Literal, ...]
    references: tuple[str, ...]


class _Values:
    """Reads what stands on the right of a sign."""

    def __init__(self, text: str):
        self.text = text
        self.unclosed: set[str] = set()  # triple quotes that no later text closes

    def string(self, at: int) -> tuple[int, int, int] | None:
        """(start, end) of the value of a string literal at a place, and where it ends."""
        text = self.text
        if (m := _TRIPLE.match(text, at)) is not None and m.group(1) not in self.unclosed:
            end = text.find(m.group(1), m.end())
            if end >= 0:
                return m.end(), end, end + 3
            self.unclosed.add(m.group(1))
        if (m := _STRING.match(text, at)) is not None:
            return *m.span(m.lastindex), m.end()
        return None

    def read(self, at: int) -> tuple[list[Literal], list[str], int]:
        """Literals and names of an expression: strings, bare values and calls, joined by plus signs."""
        text, literals, references, calls = self.text, [], [], []
        while True:
            if (s := self.string(at)) is not None:
                if s[0] < s[1] and not any(calls):
                    literals.append(Literal(text[s[0]:s[1]], s[0], s[1], True))
                at = s[2]
            elif (m := _CALL.match(text, at)) is not None:
                calls.append(_last_word(m.group(1)) in _LOOKUPS)
                at = _GAPS.match(text, m.end()).end()
                continue
            elif (m := _BARE.match(text, at)) is not None:
                bare = m.group().rstrip(".:!?")
                if _NAME_ONLY.match(bare):
                    references.append(bare)
                if bare and not calls:
                    literals.append(Literal(bare, at, at + len(bare), False))
                at = m.end()
            elif not (calls and text.startswith(")", at)):
                break
            while calls and text.startswith(")", after := _GAPS.match(text, at).end()):
                calls.pop()
                at = after + 1
            after = (_GAPS if calls else _BLANKS).match(text, at).end()
            if not text.startswith("+", after) and not (calls and text.startswith(",", after)):
                break
            at = _GAPS.match(text, after + 1).end()
        return literals, references, at


def _last_word(name: str) -> str:
    return name.rsplit(".", 1)[-1].replace("_", "").lower()


def _markup(text: str) -> Iterator[Assignment]:
    """Elements whose name tells, and tags with a key or name and a value."""
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            value = m.group(2).strip()
            start = m.start(2) + m.group(2).find(value) if value else 0
            if value:
                yield Assignment(m.group(1), (Literal(value, start, start + len(value), True),), ())
    for tag in _TAG.finditer(text) if "<" in text else ():
        found = {a.group(1).lower(): a for a in _ATTRIBUTE.finditer(tag.group())}
        value, named = found.get("value"), next((found[c] for c in ("key", "name", "id") if c in found), None)
        if value is not None and named is not None and value.group(value.lastindex):
            start, end = (tag.start() + x for x in value.span(value.lastindex))
            yield Assignment(named.group(named.lastindex), (Literal(text[start:end], start, end, True),), ())


def assignments(text: str) -> list[Assignment]:
    """Name-literal pairs of a text, from assignments of source and configuration files and from markup."""
    out, at, values = [], 0, _Values(text)
    while (m := _TARGET.search(text, at)) is not None:
        at = m.end()
        if m.group("sign") == ":" and (typed := _TYPE.match(text, at)) is not None:
            at = typed.end()
        literals, references, end = values.read(at)
        out.append(Assignment(m.group("quoted") or m.group("plain"), tuple(literals), tuple(references)))
        at = max(end, at)
    return out + list(_markup(text))


def named_literals(text: str) -> list[tuple[Literal, str, float]]:
    """Literals with the most sensitive name they reach, and their score.

    A constant hands its literals to every name it is assigned to, over any number of steps; of several assignments
    to a name, all its literals count.  Names are walked from the most sensitive ones backwards, each once, so the
    time is linear in the assignments.
    """
    found = assignments(text)
    defined: dict[str, list[Assignment]] = {}
    for a in found:
        defined.setdefault(a.name, []).append(a)
    weights = sorted(((w, name) for name in defined if (w := name_score(name))), key=lambda x: -x[0])
    told: dict[str, tuple[float, str]] = {}
    for weight, target in weights:
        waiting = [target]
        while waiting:
            name = waiting.pop()
            if name not in told and name in defined:
                told[name] = weight, target
                waiting += [r for a in defined[name] for r in a.references]
    best: dict[Literal, tuple[float, str]] = {}
    for name, (weight, target) in told.items():
        for literal in {lit: None for a in defined[name] for lit in a.literals}:
            if not literal.quoted and literal.value in defined:
                continue  # a name that stands for something else
            score = weight * literal_score(literal.value, literal.quoted)
            if score >= THRESHOLD and score > best.get(literal, (0.0, ""))[0]:
                best[literal] = (score, target)
    return [(lit, name, score) for lit, (score, name) in best.items()]


def find_secrets(text: str) -> list[dict]:
    """All spans by start, then kind: kind, start, end (characters, end exclusive), the value's span, name and score."""
    def span(kind, start, end, value, name=None, score=1.0):
        return {"kind": kind, "start": start, "end": end, "value_start": value[0], "value_end": value[1],
                "name": name, "score": score}

    signs = "=" in text or ":" in text
    markup = "</" in text
    out = [span("assign", *m.span(), m.span(2), m.group(1)) for m in (_ASSIGN.finditer(text) if signs else ())
           if len(m.group(2)) >= ASSIGN_LENGTH]
    out += [span(kind, *m.span(), m.span()) for kind, shape in (("access", _ACCESS), ("hex", _HEX))
            for m in (shape.finditer(text) if kind == "hex" or "AKIA" in text else ())]
    if signs or markup:
        covered = [(s["start"], s["end"]) for s in out]
        out += [span("named", lit.start, lit.end, (lit.start, lit.end), name, score)
                for lit, name, score in named_literals(text)
                if not any(a <= lit.start and lit.end <= b for a, b in covered)]
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


_SECRETS = ("array<struct<kind:string,start:bigint,end:bigint,value_start:bigint,value_end:bigint,"
            "name:string,score:double>>")
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("value_start", pa.int64()), ("value_end", pa.int64()), ("name", pa.string()),
                             ("score", pa.float64())]))


def scan_secrets(text: Column) -> Column:
    """array<struct<kind, start, end, value_start, value_end, name, score>> of the secrets of each whole text.

    Kinds assign, access and hex are fixed shapes.  ``named`` literals come from assignments (``name = "x"``,
    ``name: x``, ``name: type = "x"``, ``"name": "x"``, ``a["name"] = "x"``, ``name => x``) and markup whose target,
    directly or through constants, has a sensitive name; they are added where no fixed shape covers them.  Texts are independent rows: no shuffle, no size limit.
    NULL and empty texts have no secrets.
    """
    @F.arrow_udf(_SECRETS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([find_secrets(t.as_py() or "") for t in texts], type=_ARROW)

    return scan(text)


def span_list(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", filler: str = "[SECRET]") -> DataFrame:
    """``docs`` with the values of all secrets replaced by ``filler``; names and quotes around them stay."""
    from mileglass.llm.text import free_name, replace_spans

    found = free_name(docs, "secrets")
    values = F.sort_array(F.transform(F.col(found), lambda s: F.struct(
        s["value_start"].alias("start"), s["value_end"].alias("end"))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    # Overlapping values become one span.
    apart = F.aggregate(values, empty, lambda done, s: F.when(
        (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.get(done, F.size(done) - 1)["start"].alias("start"),
            F.greatest(F.get(done, F.size(done) - 1)["end"], s["end"]).alias("end"))))
    ).otherwise(F.concat(done, F.array(s))))
    return (docs.withColumn(found, scan_secrets(F.col(text)))
            .withColumn(text, F.when(F.size(found) > 0, replace_spans(F.col(text), apart, filler)).otherwise(F.col(text)))
            .drop(found))
