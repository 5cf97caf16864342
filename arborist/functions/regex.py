"""Regular expressions of XPath and XML Schema as Java patterns, and the functions that use them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborist.functions.strings import text
from arborist.xdm import XdmError

#: What may follow a backslash as itself.
_LITERAL = set("nrt\\|.?*+(){}-[]^$")
# Multi-character escapes as Java classes (without brackets).
_INITIAL = r"\p{L}_:"
_NAME = r"\p{L}\p{Nd}\p{M}\-._:·"
_ESCAPES = {
    "s": (r" \t\n\r", False), "S": (r" \t\n\r", True), "d": (r"\p{Nd}", False), "D": (r"\p{Nd}", True),
    "w": (r"\p{P}\p{Z}\p{C}", True), "W": (r"\p{P}\p{Z}\p{C}", False), "i": (_INITIAL, False), "I": (_INITIAL, True),
    "c": (_NAME, False), "C": (_NAME, True),
}
_CATEGORY = re.compile(r"(?:L[ultmo]?|M[nce]?|N[dlo]?|P[cdseifo]?|Z[slp]?|S[mcko]?|C[cfon]?)$")


class _Translator:
    def __init__(self, pattern: str, schema: bool) -> None:
        self.p, self.at, self.schema, self.groups, self.closed = pattern, 0, schema, 0, set()

    def fail(self, why: str):
        raise XdmError("FORX0002", f"{why} in {self.p!r} at {self.at}")

    def more(self) -> str:
        return self.p[self.at] if self.at < len(self.p) else ""

    def run(self) -> str:
        out = self.branches(0)
        if self.at < len(self.p):
            self.fail("unmatched )")
        return out

    def branches(self, depth: int) -> str:
        out = []
        while self.at < len(self.p):
            ch = self.more()
            if ch == ")" and depth:
                break
            if ch == ")":
                self.fail("unmatched )")
            if ch == "|":
                out.append(ch)
                self.at += 1
                continue
            atom = self.atom(depth)
            out.append(atom + self.quantifier(atom in ("^", "$") and not self.schema))
        return "".join(out)

    def atom(self, depth: int) -> str:
        ch = self.more()
        if ch == "(":
            self.at += 1
            open_ = "("
            if self.p.startswith("?:", self.at) and not self.schema:
                self.at += 2
                open_, number = "(?:", None
            else:
                self.groups += 1
                number = self.groups
            inner = self.branches(depth + 1)
            if self.more() != ")":
                self.fail("unclosed (")
            self.at += 1
            if number:
                self.closed.add(number)
            return f"{open_}{inner})"
        if ch == "[":
            return self.cls()
        if ch == "\\":
            return self.escape(False)
        if ch in "?*+{":
            self.fail(f"nothing to repeat before {ch}")
        if ch in "}]":
            self.fail(f"unescaped {ch}")
        self.at += 1
        if ch in "^$":
            return f"\\{ch}" if self.schema else ch
        if ch == ".":
            return "."
        return ch

    def quantifier(self, anchor: bool) -> str:
        m = re.compile(r"[?*+]|\{(\d+)(?:,(\d*))?\}").match(self.p, self.at)
        if m is None:
            if self.more() == "{":
                self.fail("bad quantifier")
            return ""
        if m[2] and int(m[2]) < int(m[1]):
            self.fail("quantifier out of order")
        self.at = m.end()
        lazy = ""
        if self.more() == "?" and not self.schema:
            self.at += 1
            lazy = "?"
        if self.more() and self.more() in "?*+{":
            self.fail("double quantifier")
        return m[0] + lazy

    def escape(self, inside: bool) -> str:
        self.at += 1
        ch = self.more()
        if not ch:
            self.fail("pattern ends with \\")
        self.at += 1
        if ch in _ESCAPES:
            chars, negated = _ESCAPES[ch]
            return f"[{'^' if negated else ''}{chars}]"
        if ch in "pP":
            m = re.compile(r"\{([^}]*)\}").match(self.p, self.at)
            if m is None:
                self.fail("bad property")
            self.at = m.end()
            name = m[1]
            if name.startswith("Is"):
                block = name[2:]
                if not re.fullmatch(r"[A-Za-z0-9\-]+", block):
                    self.fail(f"unknown block {block}")
                return f"\\{ch}{{In{block.replace('-', '')}}}" if block != "PrivateUse" else f"\\{ch}{{InPrivateUseArea}}"
            if not _CATEGORY.match(name):
                self.fail(f"unknown category {name}")
            return f"\\{ch}{{{name}}}"
        if ch.isdigit() and not self.schema and not inside:
            if ch == "0":
                self.fail("\\0 is no reference")
            digits = ch
            while self.more().isdigit() and int(digits + self.more()) <= self.groups:
                digits += self.more()
                self.at += 1
            if int(digits) not in self.closed:
                self.fail(f"\\{digits} refers to an open or missing group")
            return f"(?:\\{digits})"
        if ch not in _LITERAL or (ch == "$" and self.schema):
            self.fail(f"unknown escape \\{ch}")
        return f"\\{ch}"

    def cls(self) -> str:
        self.at += 1
        negated = self.more() == "^"
        self.at += negated
        parts, first = [], True
        while True:
            ch = self.more()
            if not ch:
                self.fail("unclosed [")
            if ch == "]" and not first:
                self.at += 1
                return f"[{'^' if negated else ''}{''.join(parts)}]"
            if ch == "]":
                self.fail("empty class")
            if ch == "-" and self.p.startswith("-[", self.at) and not first:
                self.at += 1
                minus = self.cls()
                if self.more() != "]":
                    self.fail("subtraction must come last")
                self.at += 1
                base = f"[{'^' if negated else ''}{''.join(parts)}]"
                return f"[{base}&&[^{minus}]]"
            if ch == "[":
                self.fail("unescaped [ in a class")
            if ch == "\\":
                lo = self.escape(True)
            else:
                self.at += 1
                lo = f"\\{ch}" if ch in "&^-[]\\#~" else ch
            first = False
            if self.more() == "-" and self.at + 1 < len(self.p) and self.p[self.at + 1] not in "[]":
                self.at += 1
                hi = self.more()
                if hi == "\\":
                    hi = self.escape(True)
                else:
                    self.at += 1
                    hi = f"\\{hi}" if hi in "&^-[]\\" else hi
                if len(lo) > 2 or len(hi) > 2 or _point(lo) > _point(hi):
                    self.fail("bad range")
                parts.append(f"{lo}-{hi}")
            else:
                parts.append(lo)


def _point(x: str) -> int:
    return ord({"\\n": "\n", "\\r": "\r", "\\t": "\t"}.get(x, x[-1]))


def java_pattern(pattern: str, flags: str = "", schema: bool = False) -> str:
    """A pattern of XPath (or, if schema, of a schema facet) as a Java pattern; FORX0001 or FORX0002 where it is invalid."""
    if set(flags) - set("smixq"):
        raise XdmError("FORX0001", f"invalid flags {flags!r}")
    if "q" in flags:
        body = re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", pattern)
    else:
        if "x" in flags:
            pattern = _without_space(pattern)
        body = _Translator(pattern, schema).run()
    if schema:
        return rf"\A(?:{body})\z"
    on = "".join(f for f in "smi" if f in flags)
    # $ without the flag m matches at the very end only; . without the flag s excludes line ends
    if "m" not in flags and "q" not in flags:
        body = _end_anchors(body)
    return f"(?d{on}{'u' if 'i' in on else ''})" + body


def _without_space(pattern: str) -> str:
    """The pattern without white space outside classes."""
    out, depth, k = [], 0, 0
    while k < len(pattern):
        ch = pattern[k]
        if ch == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        depth += (ch == "[") - (ch == "]" and depth > 0)
        if depth or ch not in " \t\r\n":
            out.append(ch)
        k += 1
    return "".join(out)


def _end_anchors(body: str) -> str:
    out, depth, k = [], 0, 0
    while k < len(body):
        ch = body[k]
        if ch == "\\":
            out.append(body[k : k + 2])
            k += 2
            continue
        depth += (ch == "[") - (ch == "]")
        out.append(r"\z" if ch == "$" and not depth else ch)
        k += 1
    return "".join(out)


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(text(c), F.lit(java_pattern(pattern, flags)))


def _matches_empty(java: str) -> bool:
    """Whether a pattern matches the empty string, which replace and tokenize refuse; asked of the JVM where there is one."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is not None:
        return session.sparkContext._jvm.java.util.regex.Pattern.compile(java).matcher("").find()
    return False


def replace(c: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    java = java_pattern(pattern, flags)
    if _matches_empty(java):
        raise XdmError("FORX0003", f"{pattern!r} matches the empty string")
    if "q" in flags:
        to = replacement.replace("\\", "\\\\").replace("$", "\\$")
    else:
        to = java_replacement(replacement, _Translator(pattern, False), pattern)
    return F.regexp_replace(text(c), java, to)


def java_replacement(replacement: str, translator: _Translator, pattern: str) -> str:
    """A replacement in Java's notation: $N takes as many digits as name a group; FORX0004 where it is invalid."""
    translator.run()
    groups, out, k = translator.groups, [], 0
    while k < len(replacement):
        ch = replacement[k]
        if ch == "\\":
            if replacement[k + 1 : k + 2] not in ("\\", "$"):
                raise XdmError("FORX0004", f"bad \\ in {replacement!r}")
            out.append(replacement[k : k + 2])
            k += 2
        elif ch == "$":
            m = re.compile(r"\d+").match(replacement, k + 1)
            if m is None:
                raise XdmError("FORX0004", f"bad $ in {replacement!r}")
            digits = m[0]
            while len(digits) > 1 and int(digits) > groups:
                digits = digits[:-1]
            # the digits that are no part of the number follow as text
            out.append(f"${int(digits)}" if int(digits) <= groups else "")
            rest = m[0][len(digits) :]
            if rest:
                out.append("\\" + rest[0] + rest[1:])
            k = m.end()
        else:
            out.append(ch)
            k += 1
    return "".join(out)


def tokenize(c: Column, pattern: str, flags: str = "") -> Column:
    """Array of tokens; empty tokens stay, the empty string has none."""
    java = java_pattern(pattern, flags)
    if _matches_empty(java):
        raise XdmError("FORX0003", f"{pattern!r} matches the empty string")
    # a separator at the start gives an empty token before it
    return F.when(text(c) == "", F.array().cast("array<string>")).otherwise(F.split(text(c), java, -1))


def dynamic(pattern: Column, flags: Column, nonempty: bool = False) -> Column:
    """Java patterns of a column of patterns, each translated once a batch; `nonempty`: FORX0003 where one matches the empty string."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(p, f):
        known: dict = {}
        for key in set(zip(p, f, strict=True)):
            known[key] = None if key[0] is None else java_pattern(key[0], key[1] or "")
        return pd.Series([known[k] for k in zip(p, f, strict=True)], dtype=object)

    java = run(pattern, flags)
    if not nonempty:
        return java
    failed = F.raise_error(F.concat(F.lit("FORX0003: matches the empty string: "), pattern)).cast("string")
    return F.when(F.rlike(F.lit(""), java), failed).otherwise(java)


def dynamic_replacement(replacement: Column, pattern: Column, flags: Column) -> Column:
    """Replacements of a column in Java's notation."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(r, p, f):
        def one(to, of, on):
            if to is None or of is None:
                return None
            if "q" in (on or ""):
                return to.replace("\\", "\\\\").replace("$", "\\$")
            return java_replacement(to, _Translator(of, False), of)

        return pd.Series([one(*x) for x in zip(r, p, f, strict=True)], dtype=object)

    return run(replacement, pattern, flags)


def analyze(c: Column, pattern: str, flags: str = "") -> Column:
    """Array of (matched, text) of the parts of a string in order, for xsl:analyze-string."""
    java = java_pattern(pattern, flags)
    if _matches_empty(java):
        raise XdmError("XTDE1150", f"{pattern!r} matches the empty string")
    found = F.regexp_extract_all(text(c), F.lit(java), F.lit(0))
    between = F.split(text(c), java, -1)
    part = lambda on, s: F.struct(on.alias("matched"), s.alias("text"))
    mixed = F.flatten(
        F.transform(between, lambda s, k: F.when(F.get(found, k).isNotNull(), F.array(part(F.lit(False), s), part(F.lit(True), F.get(found, k)))).otherwise(F.array(part(F.lit(False), s))))
    )
    return F.filter(mixed, lambda p: p["matched"] | (p["text"] != ""))


def regex_group(matched: Column, pattern: str, number: int, flags: str = "") -> Column:
    """A group of a match; "" where the number is beyond the groups."""
    t = _Translator(pattern, False)
    t.run()
    return F.regexp_extract(matched, java_pattern(pattern, flags), number) if number <= t.groups else F.lit("")


def facet(c: Column, pattern: str) -> Column:
    """Whether a schema pattern matches a whole value."""
    return F.rlike(c, F.lit(java_pattern(pattern, schema=True)))
