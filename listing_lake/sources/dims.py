"""Source, rule and dictionary dimensions, read once on the driver from configuration files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listing_lake.functions.fields import spark_pattern
from listing_lake.operators.nodes import SELECTOR, selector
from listing_lake.session import small_table

_RULE = f"struct<field:string,sel:{SELECTOR},parse:string,attr:string,many:boolean>"
SOURCES = {
    "ord": "int", "name": "string", "type": "string", "url": "string", "region": "string", "category": "string",
    "content_angle": "string", "source_tier": "string", "enabled": "boolean", "manual_only": "boolean",
    "local_only": "boolean", "respect_robots": "boolean", "max_items": "int", "page_param": "string",
    "max_pages": "int", "min_title_length": "int", "title_strip_pattern": "string",
    "allow_patterns": "array<string>", "deny_patterns": "array<string>", "title_deny_patterns": "array<string>",
    "image_deny_patterns": "array<string>", "required_text_patterns": "array<string>", "product_mode": "boolean",
    "list_product_mode": "boolean", "fetch_detail_image": "boolean", "card_alt_text": "boolean",
    "figure_only": "boolean", "price_pattern": "string", "preorder_words": "array<string>",
    "published_pattern": "string", "detail_refresh_hours": "double", "shop": "string",
    "link_sel": SELECTOR, "title_sel": SELECTOR, "published_sel": SELECTOR, "list_image_sel": SELECTOR,
    "image_sel": SELECTOR, "detail_images_sel": SELECTOR, "product_text_sel": SELECTOR, "list_item_sel": SELECTOR,
    "list_rules": f"array<{_RULE}>", "detail_rules": f"array<{_RULE}>",
    "api": (
        "struct<items_path:string,id_field:string,title_field:string,date_field:string,date_pattern:string,"
        "summary_field:string,detail_url_template:string,image_field:string,image_html_field:string,"
        "page_count_field:string,image_deny_patterns:array<string>>"
    ),
}
SOURCES_DDL = ", ".join(f"{name} {kind}" for name, kind in SOURCES.items())
_SELECTORS = {
    "link_selector": "link_sel", "title_selector": "title_sel", "published_selector": "published_sel",
    "list_image_selector": "list_image_sel", "image_selector": "image_sel",
    "detail_images_selector": "detail_images_sel", "product_text_selector": "product_text_sel",
}
_API = (
    "items_path", "id_field", "title_field", "date_field", "summary_field", "detail_url_template", "image_field",
    "image_html_field", "page_count_field",
)


def java_pattern(pattern: str | None) -> str | None:
    """A configured pattern with Unicode classes on, as its authors meant it."""
    return None if pattern is None else "(?U)" + pattern.replace("(?P<", "(?<")


def _rules(section: dict | None) -> list[dict] | None:
    fields = (section or {}).get("fields") or {}
    return [
        {
            "field": name, "sel": selector(spec["selector"]), "parse": spec.get("parse") or "text",
            "attr": spec.get("attr") or None, "many": bool(spec.get("many", False)),
        }
        for name, spec in fields.items()
    ] or None


def source_row(ord_: int, config: dict) -> dict:
    """One configured source as a row of `SOURCES`."""
    row = {name: config.get(name) for name in SOURCES}
    row["ord"] = ord_
    for key, column in _SELECTORS.items():
        row[column] = selector(config.get(key))
    for key in ("allow_patterns", "deny_patterns", "title_deny_patterns", "image_deny_patterns", "required_text_patterns"):
        row[key] = [java_pattern(p) for p in config.get(key) or []]
    for key in ("title_strip_pattern", "price_pattern"):
        row[key] = java_pattern(config.get(key))
    row["preorder_words"] = list(config.get("preorder_words") or [])
    row["published_pattern"] = spark_pattern(config.get("published_format"))
    if row["detail_refresh_hours"] is not None:
        row["detail_refresh_hours"] = float(row["detail_refresh_hours"])
    extract = config.get("extract") or {}
    row["list_item_sel"] = selector((extract.get("list") or {}).get("item"))
    row["list_rules"], row["detail_rules"] = _rules(extract.get("list")), _rules(extract.get("detail"))
    row["api"] = {key: config.get(key) for key in _API} | {
        "date_pattern": spark_pattern(config.get("date_format")), "image_deny_patterns": row["image_deny_patterns"],
    }
    return row


def sources_table(spark: SparkSession, configs: list[dict]) -> DataFrame:
    return small_table(spark, [source_row(i, c) for i, c in enumerate(configs)], SOURCES_DDL)


def with_source(df: DataFrame, sources: DataFrame, key: str = "source", out: str = "src") -> DataFrame:
    """Rows with their source's options as one struct."""
    dim = sources.select(F.col("name").alias(key), F.struct(*[c for c in SOURCES]).alias(out))
    return df.join(dim, key)


def load_config(path: str | Path) -> dict:
    """A JSON or YAML file; YAML needs its reader installed."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def read_sources(spark: SparkSession, path: str | Path, overlays: str | Path | None = None) -> DataFrame:
    """Sources of a file, with the extract overlays of a folder laid over them."""
    configs = load_config(path).get("sources", [])
    if overlays and Path(overlays).is_dir():
        extra = [load_config(p) for p in sorted(Path(overlays).iterdir()) if p.suffix in (".yaml", ".yml", ".json")]
        configs = overlay_configs(configs, extra)
    return sources_table(spark, configs)


def overlay_configs(base: list[dict], overlays: list[dict]) -> list[dict]:
    """Configured sources with overlays of the same name; overlay-only sources join at the end."""
    by_name = {o["name"].strip(): o for o in overlays}
    merged = []
    for config in base:
        over = by_name.pop(config.get("name"), None)
        extra = {}
        if over:
            if over.get("extract") is not None:
                extra["extract"] = over["extract"]
            if "shop" in over and "shop" not in config:
                extra["shop"] = over["shop"]
        merged.append(config | extra)
    for name, over in by_name.items():
        if "url" not in over:
            raise ValueError(f"overlay source {name} needs a url")
        merged.append({"type": "html", "enabled": False, "respect_robots": True} | over)
    return merged


def overlay_merge(
    base: DataFrame, overlay: DataFrame, key: str, wins: list[str], fills: list[str], defaults: dict[str, object],
    required: str | None = None,
) -> DataFrame:
    """The same merge for any two tables.

    `wins` columns come from the overlay when it has a value, `fills` only where the base has none; overlay-only rows are
    appended with `defaults`, and fail without the `required` column.
    """
    have = set(overlay.columns)
    side = overlay.select(F.col(key), F.struct(*[c for c in overlay.columns if c != key]).alias("_o"))
    pick = {c: F.coalesce(F.col(f"_o.{c}"), F.col(c)) for c in wins if c in have}
    pick |= {c: F.coalesce(F.col(c), F.col(f"_o.{c}")) for c in fills if c in have}
    kept = base.join(side, key, "left").withColumns(pick).select(*base.columns)
    extra = overlay.join(base.select(key), key, "left_anti")
    if required:
        value = F.col(required) if required in have else F.lit(None).cast("string")
        extra = extra.withColumn(required, F.when(
            value.isNull(), F.raise_error(F.concat(F.lit("overlay row needs a " + required + ": "), F.col(key).cast("string"))),
        ).otherwise(value))
    types = {f.name: f.dataType for f in base.schema.fields}

    def column(name: str) -> Column:
        value = F.col(name) if name in extra.columns else F.lit(None)
        return F.coalesce(value.cast(types[name]), F.lit(defaults.get(name)).cast(types[name])).alias(name)

    return kept.unionByName(extra.select(*[column(c) for c in base.columns]))


# --- dictionary of works ------------------------------------------------------------------------
WORKS_DDL = "ord int, name string, aliases array<string>"


def works_table(spark: SparkSession, works: list[dict]) -> DataFrame:
    """Works and aliases; an alias that is not text is an error."""
    rows = []
    for i, work in enumerate(works):
        aliases = work.get("aliases") or []
        if isinstance(aliases, str):
            aliases = aliases.replace("\n", ",").split(",")
        for alias in aliases:
            if isinstance(alias, (dict, list)):
                raise ValueError(f"{work.get('name')}: quote the alias {alias!r}")
        rows.append((i, work.get("name") or "", [str(a) for a in aliases]))
    return small_table(spark, rows, WORKS_DDL)


def read_works(spark: SparkSession, path: str | Path) -> DataFrame:
    works = load_config(path).get("works") or []
    if not isinstance(works, list):
        raise ValueError("works must be a list")
    return works_table(spark, works)
