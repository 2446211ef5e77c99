"""Reading SQL texts: a small scanner of tokens, and what tables, columns and clauses it finds."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cached_property

_COMMENT = r"--[^\n]*|/\*.*?(?:\*/|$)"
_QUOTED = r"'[^'\\]*(?:(?:\\.|'')[^'\\]*)*(?:'|$)|`[^`]*`|\"[^\"]*\"|\[[A-Za-z_][^\]\n]*\]"
#: White space, then a comment or, as a group, a token: words, quoted texts and names, and all else sign by sign.
_TOKEN = re.compile(rf"\s*+(?:([A-Za-z_][\w.$]*+|[(),;=]|\d[\w.]*|[^\W\d][\w.$]*|{_QUOTED}|(?!{_COMMENT})(?:::|.))|{_COMMENT}|)", re.DOTALL)
_UNTOLD = re.compile(rf"({_QUOTED})|{_COMMENT}", re.DOTALL)
_CLAUSES = {"group", "having", "order", "limit", "union", "cluster", "distribute", "sort", "window"}
_CONSTRAINTS = {"primary", "constraint", "unique", "foreign", "index", "key", "check"}


_KINDS = {"'": "text", "`": "name", '"': "name", "[": "name"}
#: Words and signs that are looked for in whole texts.
_SOUGHT = frozenset(("create", "insert", "select", "from", "join", "where", "on", "group", "order", "row_number", "(", ")"))
#: Signs that are in no name and between no two words that are sought together.
_ENDS = frozenset("(),;=")


def _up_to(sql: str, place: int) -> Iterator[str]:
    for m in _TOKEN.finditer(sql):
        if text := m[1]:
            yield text
            if text in _ENDS and m.start(1) > place:
                return


class Tokens:
    """Tokens of a text by columns: texts, also in lower case, how many parentheses each is in (a parenthesis counts as outside), and by each word or sign of _SOUGHT the places that it stands at.

    Columns instead of an object for each token, since most are never looked
    at; what few texts need is worked out when it is asked for.  With
    ``until`` they end at the first sign behind that place of the text which
    no name goes on after.
    """

    def __init__(self, sql: str, until: int | None = None) -> None:
        self.sql = sql
        self.texts = list(filter(None, _TOKEN.findall(sql)) if until is None else _up_to(sql, until))
        self.lows = [t.lower() for t in self.texts]
        self.places: dict[str, list[int]] = {w: [] for w in _SOUGHT}
        for k, low in enumerate(self.lows):
            if low in _SOUGHT:
                self.places[low].append(k)

    def __len__(self) -> int:
        return len(self.texts)

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        return [m.span(1) for m in _TOKEN.finditer(self.sql) if m.lastindex]

    @cached_property
    def depths(self) -> list[int]:
        out, depth = [], 0
        for k in sorted([*self.places["("], *self.places[")"]]):
            out += [depth] * (k - len(out))
            if self.lows[k] == "(":
                out.append(depth)
                depth += 1
            else:
                depth = max(depth - 1, 0)
        return out + [depth] * (len(self.texts) - len(out))

    def kind(self, k: int) -> str:
        text = self.texts[k]
        first = text[0]
        if first.isalnum() or first == "_":
            return "word"
        # a quote alone is a text at the end only
        return _KINDS.get(first, "sign") if len(text) > 1 or first == "'" and k + 1 == len(self.texts) else "sign"

    def named(self, k: int) -> bool:
        return self.kind(k) in ("word", "name")

    def name(self, k: int) -> str:
        return self.texts[k][1:-1] if self.kind(k) == "name" else self.texts[k]

    def between(self, part: Sequence[int]) -> str:
        return self.sql[self.spans[part[0]][0] : self.spans[part[-1]][1]]


def tokens(sql: str) -> Tokens:
    """Tokens without comments and white space."""
    return Tokens(sql)


def naming_tokens(sql: str) -> Tokens:
    """The tokens that tell which tables a text fills, and all of one that may define some.

    Behind the last place that may be an INSERT with its table's name nothing
    is scanned; where there is none, nothing at all.
    """
    low = sql.lower()
    if "create" in low:
        return Tokens(sql)
    # no sign is fewer in lower case, so that the place is no earlier than in the text itself
    at = low.rfind("insert")
    return Tokens(sql, at) if at >= 0 else Tokens("")


def without_comments(sql: str) -> str:
    if "--" not in sql and "/*" not in sql:
        return sql
    return _UNTOLD.sub(lambda m: m[1] or " ", sql)


def _distinct(values: Iterator[str], most: int | None = None) -> list[str]:
    return list(dict.fromkeys(values))[:most]


def _dotted(found: Tokens, at: int) -> tuple[str, int]:
    """A name with its dotted parts from a token on, and where it ends."""
    if at >= len(found) or not found.named(at):
        return "", at
    name = found.name(at)
    while at + 2 < len(found) and found.texts[at + 1] == "." and found.named(at + 2):
        name, at = f"{name}.{found.name(at + 2)}", at + 2
    return name, at + 1


def source_tables(found: Tokens, most: int = 50) -> list[str]:
    """Tables after FROM and JOIN, in order, each once."""
    names = (_dotted(found, k + 1)[0] for k in sorted([*found.places["from"], *found.places["join"]]))
    return _distinct((n for n in names if n and n.lower() not in ("select", "values", "lateral", "unnest")), most)


def _after(found: Tokens, *words: str, within: range | None = None) -> Iterator[int]:
    """The places after words that follow each other; what begins with a letter is a word."""
    lows, n = found.lows, len(words)
    end = within.stop if within is not None else len(lows)
    for k in found.places[words[0]] if within is None else within:
        if lows[k] == words[0] and k + n <= end and (n == 1 or lows[k + 1 : k + n] == list(words[1:])):
            yield k + n


def created_tables(found: Tokens) -> list[str]:
    out, lows = [], found.lows
    for k in found.places["create"]:
        at = k + 1
        while at < len(found) and lows[at] in ("external", "temporary", "or", "replace"):
            at += 1
        if at < len(found) and lows[at] == "table":
            at += 1
            if lows[at : at + 3] == ["if", "not", "exists"]:
                at += 3
            out.append(_dotted(found, at)[0])
    return _distinct(n for n in out if n)


def inserted_tables(found: Tokens) -> list[str]:
    return _distinct(n for how in ("overwrite", "into") for at in _after(found, "insert", how, "table") if (n := _dotted(found, at)[0]))


def _inside(found: Tokens, opening: int, end: int | None = None) -> tuple[range, int]:
    """The tokens between a parenthesis and its partner (before ``end``), and the place after it."""
    end, depths = len(found) if end is None else end, found.depths
    closing = next((k for k in found.places[")"] if opening < k < end and depths[k] == depths[opening]), None)
    return (range(opening + 1, end), end) if closing is None else (range(opening + 1, closing), closing + 1)


def _listed(found: Tokens, part: Sequence[int]) -> list[list[int]]:
    """A list's entries, cut at the commas of its own level."""
    if not part:
        return []
    texts, depths = found.texts, found.depths
    depth = min(depths[k] for k in part)
    out: list[list[int]] = [[]]
    for k in part:
        if texts[k] == "," and depths[k] == depth:
            out.append([])
        else:
            out[-1].append(k)
    return [x for x in out if x]


def _columns(found: Tokens, part: Sequence[int]) -> list[dict]:
    out, texts, lows = [], found.texts, found.lows
    for entry in _listed(found, part):
        first = found.kind(entry[0])
        if first not in ("word", "name") or first == "word" and lows[entry[0]] in _CONSTRAINTS:
            continue
        comment = next((texts[entry[j + 1]].strip("'\"") for j, k in enumerate(entry[:-1]) if lows[k] == "comment"), "")
        kind, before = "", first
        for k in entry[1:]:
            if lows[k] in ("comment", "not", "null", "default", "primary", "unique", "encode"):
                break
            this = found.kind(k)
            kind += (" " if kind and this == "word" and before == "word" else "") + texts[k]
            before = this
        out.append({"name": found.name(entry[0]), "type": kind, "comment": comment})
    return out


def table_definition(found: Tokens) -> dict:
    """Columns, partition columns and comment of the first CREATE TABLE."""
    out, texts, lows = {"columns": [], "partition_columns": [], "table_comment": ""}, found.texts, found.lows
    for k in _after(found, "create"):
        at = next((j for j in range(k, min(k + 12, len(found))) if texts[j] == "("), None)
        if at is None or "table" not in lows[k:at]:
            continue
        body, end = _inside(found, at)
        out["columns"] = _columns(found, body)
        stop = next((j for j in range(end, len(found)) if texts[j] == ";"), len(found))
        for j in _after(found, "partitioned", "by", within=range(end, stop)):
            if j < stop and texts[j] == "(":
                out["partition_columns"] = _columns(found, _inside(found, j, stop)[0])
        for j in range(end, stop - 1):
            if lows[j] == "comment" and (texts[j + 1] == "=" or found.depths[j] == found.depths[at] and found.kind(j + 1) in ("text", "name")):
                told = j + 1 if texts[j + 1] != "=" else min(j + 2, stop - 1)
                out["table_comment"] = texts[told].strip("'\"")[:500]
                break
        if not out["table_comment"]:
            for j in range(end, stop - 2):
                if texts[j + 1] == "=" and lows[j].strip("'\"") == "comment" and found.kind(j) in ("text", "name"):
                    out["table_comment"] = texts[j + 2].strip("'\"")[:500]
                    break
        break
    return out


def signals(found: Tokens, sql: str) -> dict:
    """What an ETL text reads and how it removes duplicates."""
    group, keys, texts, lows, depths = [], [], found.texts, found.lows, found.depths
    for at in _after(found, "group", "by"):
        level = depths[at - 1]
        end = at
        while end < len(found) and not (depths[end] < level or texts[end] == ";" or depths[end] == level and lows[end] in _CLAUSES or texts[end] == ")" and depths[end] <= level - 1):
            end += 1
        group = [found.between(e) for e in _listed(found, range(at, end))][:12]
        break
    for at in _after(found, "row_number"):
        over = next((k for k in range(at, min(at + 4, len(found))) if lows[k] == "over"), None)
        if over is None or over + 1 >= len(found) or texts[over + 1] != "(":
            continue
        body, _ = _inside(found, over + 1)
        part = []
        for j in _after(found, "partition", "by", within=body):
            part += range(j, next((k for k in range(j, body.stop) if lows[k] == "order" and depths[k] == depths[j]), body.stop))
        keys = [found.between(e) for e in _listed(found, part)]
        break
    return {
        "source_tables": source_tables(found, 30),
        "group_by": group,
        "row_number_keys": keys,
        "has_distinct": any(True for _ in _after(found, "select", "distinct")),
        "has_row_number": bool(found.places["row_number"]),
    }


def clause(found: Tokens, sql: str, begin: str, stops: set[str]) -> str:
    """The text of the last clause at the outermost level that begins with a word, up to any of the stops."""
    at = [k for k in found.places[begin] if found.depths[k] == 0]
    if not at:
        return ""
    end = next((found.spans[k][0] for k in range(at[-1] + 1, len(found)) if found.depths[k] == 0 and (found.texts[k] == ";" or found.lows[k] in stops)), len(sql))
    return sql[found.spans[at[-1]][1] : end]


def select_list(found: Tokens, sql: str) -> str:
    return clause(found, sql, "select", {"from"})


def where_text(found: Tokens, sql: str) -> str:
    """The first WHERE up to the next clause."""
    if not found.places["where"]:
        return ""
    at = found.places["where"][0]
    level = found.depths[at]
    end = next((found.spans[k][0] for k in range(at + 1, len(found)) if found.texts[k] == ";" or found.depths[k] < level or found.lows[k] in _CLAUSES and found.depths[k] == level), len(sql))
    return sql[found.spans[at][1] : end]


def output_names(text: str) -> list[str]:
    """The names that a SELECT list gives: aliases, or the last part of plain columns."""
    found = tokens(text)
    return [found.name(entry[-1]).split(".")[-1].lower() for entry in _listed(found, range(len(found))) if found.named(entry[-1])]


def order_names(found: Tokens, sql: str) -> list[str]:
    """What the outermost ORDER BY sorts by: names, or numbers of columns."""
    at = [k for k in _after(found, "order", "by") if found.depths[k - 1] == 0]
    if not at:
        return []
    end = next((k for k in range(at[-1], len(found)) if found.texts[k] == ";" or found.depths[k] == 0 and found.lows[k] in ("limit", "union")), len(found))
    out = []
    for entry in _listed(found, range(at[-1], end)):
        words = [k for k in entry if found.lows[k] not in ("asc", "desc", "nulls", "first", "last")]
        if len(words) == 1 and found.named(words[0]):
            out.append(found.name(words[0]).split(".")[-1].lower())
    return out


def on_clauses(found: Tokens, sql: str, most: int = 20) -> list[str]:
    """ON conditions at the outermost level."""
    out = []
    stops = {"join", "left", "right", "inner", "full", "cross", "where", "on", "lateral"} | _CLAUSES
    for k in found.places["on"]:
        if found.depths[k] == 0:
            end = next((found.spans[j][0] for j in range(k + 1, len(found)) if found.texts[j] == ";" or found.depths[j] == 0 and found.lows[j] in stops), len(sql))
            out.append(sql[found.spans[k][1] : end])
    return out[:most]
