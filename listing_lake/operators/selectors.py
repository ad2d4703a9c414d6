"""CSS selectors over the nodes of one page, matched while the page is read.

A selector is compiled into compounds, each a test of one element, and chains of compounds. Every distinct element form of a page
is tested once against the compounds. Then one sweep from the last node to the first settles what elements hold, and one from the
first to the last carries, in the bits of a number, which beginnings of a chain end at an element or above it. Both take time and
memory in proportion to the nodes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

_PIECE = re.compile(
    r"""(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"""
    r"""|\[(?P<attr>[\w:-]+)\s*(?:(?P<op>[\^*$~]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]]*)))?\s*\]"""
    r"""|:(?P<fn>not|has|-soup-contains)\(|(?P<scope>:scope)"""
)


def split_top(text: str, pattern: str) -> list[str]:
    """Split outside of brackets, parentheses and quotes."""
    out, depth, quote, current = [], 0, "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        if not depth and not quote and re.fullmatch(pattern, ch):
            out.append(current)
            current = ""
        else:
            current += ch
    return [*out, current]


def _attr_test(name: str, op: str | None, value: str):
    """A test of one attribute; class lists are compared with single blanks."""
    def of(attrs: dict) -> str | None:
        got = attrs.get(name)
        return " ".join(got.split()) if name == "class" and got is not None else got

    if op is None:
        return lambda tag, attrs: name in attrs
    tests = {
        "=": lambda got: got == value, "^=": lambda got: got.startswith(value), "$=": lambda got: got.endswith(value),
        "*=": lambda got: value in got, "~=": lambda got: value in got.split(),
    }
    return lambda tag, attrs: of(attrs) is not None and tests[op](of(attrs))


@dataclass
class Compound:
    """Tests of one element: of its own form, of chains it must not end, of what it must hold and of words in its text.

    `inner_nots` are those of a compound inside `:has`.
    """

    own: list = field(default_factory=list)
    nots: list = field(default_factory=list)
    inner_nots: list = field(default_factory=list)
    has: list = field(default_factory=list)
    words: list[str] = field(default_factory=list)


@dataclass
class Chain:
    """Compounds from the outermost to the element itself; `child[i]` tells whether step i is a child of step i - 1 or of the anchor."""

    steps: list[int]
    child: list[bool]
    first: int = 0


class Program:
    """Some selectors, compiled together. Beginnings of chains are numbered one after the other, so that a shift is a step along a chain."""

    def __init__(self, parts: tuple[str, ...]):
        self.compounds: list[Compound] = []
        self.down: list[Chain] = []
        self.up: list[Chain] = []
        self.forms: dict = {}
        # Chains that end at an element: the selectors asked for, by the place of their last bit.
        self.asked = [(part, *self._selector(part)) for part in parts]
        self.down_masks, self.down_first, self.down_child = self._masks(self.down)
        self.up_masks, self.up_first, self.up_child = self._masks(self.up)
        self.up_last = sum(1 << c.first + len(c.steps) - 1 for c in self.up)
        self.ends = sum(1 << c.first + len(c.steps) - 1 for _, c, _ in self.asked)
        self.content = any(c.has or c.words for c in self.compounds)

    def _masks(self, chains: list[Chain]) -> tuple[list[int], int, int]:
        masks, first, child, at = [0] * len(self.compounds), 0, 0, 0
        for chain in chains:
            chain.first = at
            first |= 1 << at
            for i, step in enumerate(chain.steps):
                masks[step] |= 1 << at + i
                child |= chain.child[i] << at + i
            at += len(chain.steps)
        return masks, first, child

    def _selector(self, part: str) -> tuple[Chain, bool]:
        scoped = part.startswith(":scope")
        chain = self._chain(part[len(":scope"):] if scoped else part, part, inside=False)
        self.down.append(chain)
        return chain, scoped

    def _chain(self, text: str, whole: str, inside: bool) -> Chain:
        pieces = [p for p in split_top(re.sub(r"\s*>\s*", " > ", text.strip()), r"\s") if p]
        steps, child, direct = [], [], False
        for piece in pieces:
            if piece == ">":
                direct = True
                continue
            if piece in ("+", "~"):
                raise ValueError(f"unsupported selector: {whole}")
            steps.append(self._compound(piece, whole, inside))
            child.append(direct)
            direct = False
        if not steps or direct:
            raise ValueError(f"unsupported selector: {whole}")
        return Chain(steps, child)

    def _compound(self, text: str, whole: str, inside: bool) -> int:
        """Number of a compound such as `a.name[href^="/x"]`; those it depends on have smaller numbers."""
        made, at = Compound(), 0
        while at < len(text):
            m = _PIECE.match(text, at)
            if not m or m["scope"]:
                raise ValueError(f"unsupported selector: {whole}")
            at = m.end()
            if m["fn"]:
                depth, end, quote = 1, at, ""
                while depth and end < len(text):
                    ch = text[end]
                    if quote:
                        quote = "" if ch == quote else quote
                    elif ch in "\"'":
                        quote = ch
                    else:
                        depth += {"(": 1, ")": -1}.get(ch, 0)
                    end += 1
                self._function(made, m["fn"], text[at:end - 1].strip(), whole, inside)
                at = end
            elif m["tag"]:
                if m["tag"] != "*":
                    made.own.append(lambda tag, attrs, want=m["tag"].lower(): tag == want)
            elif m["id"]:
                made.own.append(lambda tag, attrs, want=m["id"]: attrs.get("id") == want)
            elif m["cls"]:
                made.own.append(lambda tag, attrs, want=m["cls"]: want in (attrs.get("class") or "").split())
            else:
                value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")
                made.own.append(_attr_test(m["attr"].lower(), m["op"], value))
        self.compounds.append(made)
        return len(self.compounds) - 1

    def _function(self, made: Compound, name: str, argument: str, whole: str, inside: bool) -> None:
        if name == "-soup-contains":
            made.words.append(argument.strip("\"'"))
            return
        chains = [self._chain(a, whole, inside or name == "has") for a in split_top(argument, ",")]
        if name == "has":
            self.up += chains
            made.has.append(chains)
        elif inside and any(len(c.steps) > 1 for c in chains):
            # What stands above an element is not known yet when the elements that hold it are settled.
            raise ValueError(f"unsupported selector: {whole}")
        elif inside:
            self.up += chains
            made.inner_nots += chains
        else:
            self.down += chains
            made.nots += chains

    # --- one page -----------------------------------------------------------------------------------
    def passing(self, tag: str, attrs: dict) -> list[int]:
        """Compounds whose own tests an element of this form passes; each form is tested once."""
        form = (tag, tuple(attrs.items()))
        found = self.forms.get(form)
        if found is None:
            if len(self.forms) > 20_000:
                self.forms.clear()
            found = self.forms[form] = [i for i, c in enumerate(self.compounds) if all(t(tag, attrs) for t in c.own)]
        return found

    def match(self, nodes: list[dict]) -> None:
        """Adds `hits` to the elements: (css, at) of every selector that ends there; of a scoped one, `at` holds the ids of its scopes,
        or without a direct step the largest id above which a scope may lie."""
        fits = [self.passing(n["tag"], n["attrs"]) if n["text"] is None else [] for n in nodes]
        if self.content:
            self._settle_content(nodes, fits)
        matched, above = [0] * len(nodes), [0] * len(nodes)
        descend = ~self.down_child
        for i, node in enumerate(nodes):
            up = node["parent"]
            here, outer = (matched[up], above[up]) if up is not None else (0, 0)
            reach = self.down_first | (here << 1 & self.down_child) | (outer << 1 & descend)
            own = 0
            for c in fits[i]:
                if not any((own & reach) >> k.first + len(k.steps) - 1 & 1 for k in self.compounds[c].nots):
                    own |= self.down_masks[c]
            matched[i] = own & reach
            above[i] = outer | matched[i]
            if matched[i] & self.ends:
                node["hits"] = [
                    {"css": css, "at": self._scopes(nodes, matched, i, chain) if scoped else None}
                    for css, chain, scoped in self.asked if matched[i] >> chain.first + len(chain.steps) - 1 & 1]

    def _settle_content(self, nodes: list[dict], fits: list[list[int]]) -> None:
        """Drops compounds from elements that do not hold what they must; inner tests are settled before outer ones."""
        runs, starts, size = [], [], 0
        for node in nodes:
            starts.append(size)
            if node["tag"] == "#text":
                runs.append(node["text"])
                size += len(node["text"])
        starts.append(size)
        text, places = "".join(runs), {}
        for word in {w for c in self.compounds for w in c.words}:
            places[word] = [m.start() for m in re.finditer(f"(?={re.escape(word)})", text)]
        child, deep = [0] * len(nodes), [0] * len(nodes)
        descend = ~self.up_child
        for i in range(len(nodes) - 1, -1, -1):
            kept, own = [], 0
            reach = self.up_last | (child[i] & self.up_child) >> 1 | (deep[i] & descend) >> 1
            for c in fits[i]:
                made = self.compounds[c]
                if made.words and not all(self._within(places[w], len(w), starts[i], starts[nodes[i]["last"] + 1]) for w in made.words):
                    continue
                if not all(any((child if k.child[0] else deep)[i] >> k.first & 1 for k in group) for group in made.has):
                    continue
                if any(own >> k.first & 1 for k in made.inner_nots):
                    continue
                kept.append(c)
                own |= self.up_masks[c]
            fits[i] = kept
            here, up = own & reach, nodes[i]["parent"]
            if up is not None:
                child[up] |= here
                deep[up] |= here | deep[i]

    @staticmethod
    def _within(places: list[int], size: int, start: int, end: int) -> bool:
        at = bisect_left(places, start)
        return at < len(places) and places[at] + size <= end

    def _scopes(self, nodes: list[dict], matched: list[int], i: int, chain: Chain) -> list[int]:
        """Where the scope of a match may stand: parents of all first steps, or the last first step if the scope is anywhere above it."""
        tops = {i}
        for step in range(len(chain.steps) - 1, 0, -1):
            bit, before = chain.first + step - 1, set()
            for at in tops:
                up = nodes[at]["parent"]
                while up is not None:
                    if matched[up] >> bit & 1:
                        before.add(up)
                    if chain.child[step]:
                        break
                    up = nodes[up]["parent"]
            tops = before
        if not chain.child[0]:
            return [max(tops)]
        return sorted({-1 if nodes[t]["parent"] is None else nodes[t]["parent"] for t in tops})


@lru_cache(maxsize=256)
def compiled(parts: tuple[str, ...]) -> Program:
    return Program(parts)


def parse(css: str) -> list[dict]:
    """The alternatives of a selector, each with its own text; raises for what is not supported."""
    rows = []
    for part in split_top(css, ","):
        part = part.strip()
        scoped = part.startswith(":scope")
        rows.append({"css": part, "scoped": scoped, "direct": scoped and part[len(":scope"):].lstrip().startswith(">")})
        Program((part,))
    return rows
