"""Patterns of a linear-time dialect, rewritten for the JVM's engine.

Accepted are patterns without look-around, back-references, possessive or
nested quantifiers, and only the escapes that the dialect has.  Whatever means
something else to the JVM is rewritten: named and POSIX classes, quoted runs,
the anchors, word boundaries, the dot's line ends, case folding beyond ASCII,
octal escapes, braces that are no repetition, and named groups.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..model import InvalidPattern

_META = set("\\.+*?()|[]{}^$")
_MOST_REPEATS = 1000

#: The dialect's classes, as members of a bracket expression.
PERL = {"d": "0-9", "s": r"\t\n\f\r ", "w": "0-9A-Za-z_"}
POSIX = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
_CHARS = {"a": r"\x07", "f": r"\f", "t": r"\t", "n": r"\n", "r": r"\r", "v": r"\x0B"}
_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_NO_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_GROUP_NAME = re.compile(r"\(\?P?<(\w+)>")
_FLAGS = re.compile(r"\(\?([ims]*)(-[ims]+)?([:)])")


def is_literal(pattern: str) -> bool:
    """Whether a pattern means itself."""
    return not _META & set(pattern)


class _Rewriter:
    def __init__(self, pattern: str):
        self.p, self.i, self.out = pattern, 0, ["(?d)"]
        self.multiline = [False]  # of the open groups, the innermost last
        self.can_repeat = False  # whether something stands before that a quantifier may follow

    def whole(self) -> str:
        while self.i < len(self.p):
            self.one()
        if len(self.multiline) > 1:
            raise InvalidPattern("missing )")
        return "".join(self.out)

    def emit(self, text: str, taken: int, repeatable: bool = True) -> None:
        self.out.append(text)
        self.i += taken
        self.can_repeat = repeatable

    def one(self) -> None:
        c = self.p[self.i]
        if c == "\\":
            self.escape()
        elif c == "[":
            self.brackets()
        elif c == "(":
            self.group()
        elif c == ")":
            if len(self.multiline) == 1:
                raise InvalidPattern("unexpected )")
            self.multiline.pop()
            self.emit(c, 1)
        elif c in "*+?":
            self.quantifier(c)
        elif c == "{":
            found = _REPEAT.match(self.p, self.i)
            if not found:
                self.emit(r"\{", 1)
            else:
                least, most = int(found[1]), int(found[3] or found[1])
                if max(least, most) > _MOST_REPEATS or most < least:
                    raise InvalidPattern(f"bad repetition {found[0]}")
                self.quantifier(found[0])
        elif c == "}":
            self.emit(r"\}", 1)
        elif c == "]":
            self.emit(r"\]", 1)
        elif c == "$":
            self.emit(r"(?=\n|\z)" if self.multiline[-1] else r"\z", 1)
        elif c == "^":
            self.emit(r"(?:\A|(?<=\n))" if self.multiline[-1] else r"\A", 1)
        else:
            self.emit(c, 1, c != "|")

    def quantifier(self, text: str) -> None:
        if not self.can_repeat:
            raise InvalidPattern(f"nothing to repeat before {text}")
        lazy = self.p.startswith("?", self.i + len(text))
        self.emit(text + ("?" if lazy else ""), len(text) + lazy, False)

    def group(self) -> None:
        self.multiline.append(self.multiline[-1])
        if not self.p.startswith("(?", self.i):
            return self.emit("(", 1, False)
        if named := _GROUP_NAME.match(self.p, self.i):
            return self.emit("(", len(named[0]), False)
        found = _FLAGS.match(self.p, self.i)
        if not found or found[0] in ("(?)", "(?-)"):
            raise InvalidPattern("look-around, atomic groups and this flag aren't supported")
        on, off, end = found[1], found[2] or "", found[3]
        if end == ")":
            self.multiline.pop()
        if "m" in on or "m" in off:
            self.multiline[-1] = "m" not in off
        keep = lambda flags: flags.replace("m", "").replace("i", "iu")
        off = "-" + keep(off[1:]) if keep(off[1:]) else ""
        self.emit("" if end == ")" and not (keep(on) + off) else f"(?{keep(on)}{off}{end}", len(found[0]), False)

    def escape(self) -> None:
        n = self.p[self.i + 1 : self.i + 2]
        if n == "Q":
            stop = self.p.find("\\E", self.i + 2)
            body = self.p[self.i + 2 : stop if stop >= 0 else len(self.p)]
            return self.emit("".join(map(_literal, body)), len(body) + (4 if stop >= 0 else 2), bool(body))
        if n == "b":
            return self.emit(_BOUNDARY, 2)
        if n == "B":
            return self.emit(_NO_BOUNDARY, 2)
        if n in ("A", "z"):
            return self.emit("\\" + n, 2)
        text, taken, is_class = self.member()
        self.emit(f"[{text}]" if is_class else text, taken)

    def member(self) -> tuple[str, int, bool]:
        """An escape as a member of a bracket expression: its text, what it takes of the pattern, and whether it is a class."""
        n = self.p[self.i + 1 : self.i + 2]
        if not n:
            raise InvalidPattern("trailing backslash")
        if n.lower() in PERL:
            body = PERL[n.lower()]
            return (body if n.islower() else f"[^{body}]"), 2, True
        if n in _CHARS:
            return _CHARS[n], 2, False
        if n in "pP":
            found = re.compile(r"\\[pP](?:\{(\^?)(\w+)\}|([A-Z]))").match(self.p, self.i)
            if not found:
                raise InvalidPattern(f"bad class \\{n}")
            name = found[2] or found[3]
            negative = (n == "P") != bool(found[1])
            return f"\\{'P' if negative else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}", len(found[0]), True
        if n == "x":
            found = re.compile(r"\\x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))").match(self.p, self.i)
            if not found or int(found[1] or found[2], 16) > 0x10FFFF:
                raise InvalidPattern("bad \\x escape")
            return f"\\x{{{found[1] or found[2]}}}", len(found[0]), False
        if n.isdigit():
            found = re.compile(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})").match(self.p, self.i)
            if not found:
                raise InvalidPattern(f"unsupported escape \\{n}")
            return f"\\x{{{int(found[1], 8):x}}}", len(found[0]), False
        if n.isascii() and n.isalnum() or not n.isascii():
            raise InvalidPattern(f"unsupported escape \\{n}")
        return _literal(n), 2, False

    def brackets(self) -> None:
        start, self.i, parts = self.i, self.i + 1, []
        negative = self.p.startswith("^", self.i)
        self.i += negative
        first = True
        while first or not self.p.startswith("]", self.i):
            if self.i >= len(self.p):
                raise InvalidPattern("missing ]")
            c = self.p[self.i]
            named = re.compile(r"\[:(\^?)(\w+):\]").match(self.p, self.i)
            if named:
                if named[2] not in POSIX:
                    raise InvalidPattern(f"unknown class {named[0]}")
                body = POSIX[named[2]]
                parts.append(f"[^{body}]" if named[1] else body)
                self.i += len(named[0])
            elif c == "\\":
                text, taken, _ = self.member()
                parts.append(text)
                self.i += taken
            elif c == "-" and not first and not self.p.startswith("]", self.i + 1):
                parts.append("-")
                self.i += 1
            else:
                parts.append(_literal(c))
                self.i += 1
            first = False
        made = "[" + "^" * negative + "".join(parts) + "]"
        self.i += 1
        self.out.append(made)
        self.can_repeat = True
        assert self.i > start


def _literal(c: str) -> str:
    return "\\" + c if c.isascii() and not c.isalnum() and c not in "\n\r\t " else c


def to_jvm(pattern: str) -> str:
    """The pattern with the same matches on the JVM; InvalidPattern if there is none."""
    made = _Rewriter(pattern).whole()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(made)
        except Exception as e:
            raise InvalidPattern(str(e).splitlines()[0]) from None
    return made
