"""BibTeX entries: a brace-balanced scan in a Python table function's stead, one file a row."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ENTRY = "type string, key string, fields map<string,string>, pos int"
#: Accent commands and the combining marks they stand for (fixed values).
ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "c": "\u0327", "v": "\u030c"}
ACCENTED = re.compile(r"""\\(?:(["'`^~])\s*|([cv])(?:\s+|(?=\{)))(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))""")
CLOSERS = {"{": "}", "(": ")"}


class Scanner:
    """Reads entries from left to right; comments, preambles and string definitions are passed over."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def balanced(self, opener: str) -> str:
        """What stands between an opener, just passed, and its closer."""
        closer, depth, begin, braces = CLOSERS[opener], 1, self.at, 0
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\":
                self.at += 1
            elif opener == "(" and c in "{}":
                braces += 1 if c == "{" else -1
            elif c == opener and not braces:
                depth += 1
            elif c == closer and not braces:
                depth -= 1
                if not depth:
                    return self.text[begin : self.at - 1]
        return self.text[begin:]

    def entries(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        while (at := self.text.find("@", self.at)) >= 0:
            self.at = at + 1
            stop = self.at
            while stop < len(self.text) and (self.text[stop].isalnum() or self.text[stop] in " \t_-"):
                stop += 1
            if stop >= len(self.text) or self.text[stop] not in CLOSERS:
                continue
            kind = self.text[self.at : stop].strip().lower()
            self.at = stop + 1
            body = self.balanced(self.text[stop])
            if kind and kind not in ("comment", "preamble", "string"):
                key, _, rest = body.partition(",")
                yield kind, key.strip(), fields(rest)


def accented(value: str) -> str:
    """Accent commands as composed letters."""
    return unicodedata.normalize("NFC", ACCENTED.sub(lambda m: (m[3] or m[4]) + ACCENTS[m[1] or m[2]], value))


def fields(body: str) -> dict[str, str]:
    """Fields of an entry's body; parts of a value joined by # are concatenated."""
    out: dict[str, str] = {}
    at = 0
    while (eq := body.find("=", at)) >= 0:
        name = body[at:eq].strip(" \t\r\n,").lower()
        at, value = eq + 1, ""
        while True:
            while at < len(body) and body[at].isspace():
                at += 1
            if at >= len(body):
                break
            if body[at] == "{":
                s = Scanner(body)
                s.at = at + 1
                value += s.balanced("{")
                at = s.at
            elif body[at] == '"':
                end, depth = at + 1, 0
                while end < len(body) and (body[end] != '"' or depth):
                    depth += (body[end] == "{") - (body[end] == "}")
                    end += 1
                value += body[at + 1 : end]
                at = end + 1
            else:
                end = at
                while end < len(body) and body[end] not in ",#":
                    end += 1
                value += body[at:end].strip()
                at = end
            while at < len(body) and body[at].isspace():
                at += 1
            if at < len(body) and body[at] == "#":
                at += 1
                continue
            break
        if name:
            out[name] = accented(value)
        at = body.find(",", at) + 1 or len(body)
    return out


def parse(text: str) -> list[tuple[str, str, dict[str, str]]]:
    return list(Scanner(text).entries())


def entries(files: DataFrame) -> DataFrame:
    """Entries of files given as rows of column ``value``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, key, f, i) for text in b["value"] for i, (k, key, f) in enumerate(parse(text))]
            yield pd.DataFrame(rows, columns=["type", "key", "fields", "pos"]).astype({"pos": "int32"})

    return files.select("value").mapInPandas(run, ENTRY)
