"""Questions about the nodes of one page, as expressions over the `nodes` array."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listing_lake.functions.text import blank_to_null, let, strip
from listing_lake.functions.urls import LAZY_ATTRS
from listing_lake.operators.selectors import parse

# --- fixed values: must equal the stored data's rules -------------------------------------------
HIDDEN_CLASS_HINTS = ("displaynone", "d-none", "hidden", "hide", "invisible")
MIN_SIDE = 80
MAX_CARD_DEPTH = 8
HEAD_IMAGE_SELECTORS = (
    'meta[property="og:image"]', 'meta[property="og:image:url"]', 'meta[name="twitter:image"]', 'link[rel="image_src"]',
)
# ------------------------------------------------------------------------------------------------

# --- selectors ----------------------------------------------------------------------------------
# A selector is data: the alternatives it names. The page reader matches them all, so one plan serves any number of sources.
SELECTOR = "array<struct<css:string,scoped:boolean,direct:boolean>>"
# What the library itself asks of pages.
FIXED_SELECTORS = (
    *HEAD_IMAGE_SELECTORS, "a[href]", "img", "h1", "h2", ".product_name", ".prd_name", ".goods_name", ".item_name", ".name",
    'a[href*="/shop/detail.php"]', 'a[href*="detail.php"]',
)


def selector(css: str | None) -> list[dict] | None:
    """A configured CSS selector as rows of `SELECTOR`; null stays null."""
    return parse(css) if css else None


def literal_selector(css: str) -> Column:
    """A selector as a constant column. The pages must have been read with it, see `shred_pages`."""
    return F.array(*[F.struct(*[F.lit(value).alias(name) for name, value in row.items()]) for row in selector(css)])


# --- subtrees and text --------------------------------------------------------------------------
def span(nodes: Column, first: Column, last: Column) -> Column:
    """Elements `first` to `last` of an array, in time of what is taken: a slice inside a lambda copies the whole array first."""
    return F.transform(F.sequence(first, last), lambda i: F.get(nodes, i))


def subtree(nodes: Column, n: Column) -> Column:
    """The node and everything below it."""
    return span(nodes, n["id"], n["last"])


def below(nodes: Column, n: Column) -> Column:
    return F.slice(span(nodes, n["id"], n["last"]), 2, n["last"] - n["id"])


def node(nodes: Column, node_id: Column) -> Column:
    return F.try_element_at(nodes, node_id + 1)


def joined_text(part: Column, sep: str) -> Column:
    """Text runs of a slice of nodes, in order."""
    runs = F.transform(F.filter(part, lambda x: x["tag"] == "#text"), lambda x: x["text"])
    return F.array_join(runs, sep)


def text_of(nodes: Column, n: Column, sep: str = " ") -> Column:
    return joined_text(subtree(nodes, n), sep)


def visible_text(part: Column, sep: str = "\n") -> Column:
    """Text of a slice without subtrees hidden by class or style; what hides the slice as a whole from outside does not count."""
    def shown(nodes: Column) -> Column:
        first = F.try_element_at(nodes, F.lit(1))["id"]
        return F.filter(nodes, lambda x: (x["tag"] == "#text") & (x["veil"] < first))

    return F.array_join(F.transform(let(part, shown), lambda x: x["text"]), sep)


def matches(n: Column, sel: Column, root: Column | None = None) -> Column:
    """Whether element `n` matches any alternative of `sel`; `:scope` means `root`, else the page."""
    scope = root["id"] if root is not None else F.lit(-1)

    def one(alt: Column) -> Column:
        return F.exists(n["hits"], lambda hit: (hit["css"] == alt["css"]) & (
            ~alt["scoped"] | F.when(alt["direct"], F.array_contains(hit["at"], scope)).otherwise(hit["at"][0] > scope)))

    return n["hits"].isNotNull() & F.exists(sel, one)


def select_in(nodes: Column, root: Column, sel: Column) -> Column:
    """Elements below `root` that match, in document order."""
    return F.filter(below(nodes, root), lambda n: matches(n, sel, root))


def select_all(nodes: Column, sel: Column) -> Column:
    """Elements of the whole page that match, in document order."""
    return F.filter(nodes, lambda n: matches(n, sel))


# --- images -------------------------------------------------------------------------------------
def image_candidates(n: Column) -> Column:
    """Raw links of an <img> in the order they are tried; null for icons below 80 by 80."""
    a = n["attrs"]
    side = lambda name: F.coalesce(strip(a[name]).try_cast("int") < MIN_SIDE, F.lit(False))
    srcset = F.coalesce(blank_to_null(a["srcset"]), a["data-srcset"])
    first = F.regexp_extract(F.trim(F.split_part(srcset, F.lit(","), F.lit(1))), r"^[^ ]*", 0)
    raw = F.array_compact(F.array(*[a[name] for name in LAZY_ATTRS], first))
    return F.when((n["tag"] == "img") & ~(side("width") & side("height")), raw)


def images_of(selected: Column) -> Column:
    """array<array<string>>: raw link candidates of every image node of a selection."""
    return F.array_compact(F.transform(selected, image_candidates))


# --- cards --------------------------------------------------------------------------------------
def with_gaps(links: Column, size: Column) -> Column:
    """Links, structs (id, key) in document order, with `low` and `high`: the ids of the nearest links with another key on either side.

    Neighbours of one key form a run and share both, so one pass over the runs does for all.
    """
    def begins(ks: Column) -> Column:
        other = lambda i: (i == 0) | (F.get(ks, i)["key"] != F.get(ks, i - 1)["key"])
        return F.when(F.size(ks) > 0, F.filter(F.sequence(F.lit(0), F.size(ks) - 1), other)).otherwise(F.array().cast("array<int>"))

    def run(ks: Column, starts: Column) -> Column:
        def links_of(begin: Column, nth: Column) -> Column:
            end = F.coalesce(F.get(starts, nth + 1), F.size(ks))
            low = F.coalesce(F.get(ks, begin - 1)["id"], F.lit(-1))
            high = F.coalesce(F.get(ks, end)["id"], size)
            return F.transform(span(ks, begin, end - 1), lambda k: F.struct(
                k["id"].alias("id"), k["key"].alias("key"), low.alias("low"), high.alias("high")))

        return F.flatten(F.transform(starts, links_of))

    # Both are named once, so that an optimiser that writes a column out in place does not compute it once per link.
    return let(links, lambda ks: let(begins(ks), lambda starts: run(ks, starts)))


def card_of(nodes: Column, link: Column) -> Column:
    """Id of the widest of 8 ancestors that holds no other item's link.

    `link` comes from `with_gaps`. An ancestor holds another item exactly when its range reaches the nearest link with a
    different key on either side.
    """
    near = F.transform(node(nodes, link["id"])["near"], lambda i: node(nodes, i))
    fits = F.filter(near, lambda a: ~a["tag"].isin("body", "html") & (link["low"] < a["id"]) & (link["high"] > a["last"]))
    return F.try_element_at(fits, F.lit(-1))["id"]
