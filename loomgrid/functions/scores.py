"""Score, key and ranking expressions of candidate rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


#: Detector sizes that count as one family.
_SIZES, _FAMILY = "(?i)grounding-dino-(tiny|base)", "grounding-dino"


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def source_family(source: Column, declared: Column | None = None) -> Column:
    """A declared family, else the source up to its last slash; detector sizes fall together."""
    own = F.regexp_replace(source, "/[^/]*$", "")
    named = own if declared is None else F.coalesce(F.nullif(F.trim(declared), F.lit("")), own)
    return F.regexp_replace(named, _SIZES, _FAMILY)


def root_key(origin: Column, index: Column) -> Column:
    return F.when(index.isNotNull(), F.concat(F.coalesce(origin, F.lit("legacy")), F.lit("::"), index.cast("string")))


def scope_key(scene: Column, root: Column) -> Column:
    return F.coalesce(F.concat(F.lit("scene::"), scene), root, F.lit("unscoped"))


# The weights of the two formulas below.
def calibrated(score: Column, reliability: Column, agreement: Column) -> Column:
    return clip((0.45 + 0.55 * clip(score, 0.0, 1.0)) * reliability * agreement, 0.01, 0.995)


def strength(score: Column, reliability: Column, geometry: Column, corroboration: Column, confirmed: Column) -> Column:
    return 0.58 * score + 0.14 * reliability + 0.13 * geometry + 0.15 * corroboration + F.when(confirmed, 0.08).otherwise(0.0)


def side(cx: Column, ref_x: Column, width: Column, x0: Column, x1: Column, dead_zone: float = 0.04) -> Column:
    """left / right of a reference line; center if the box straddles it or the centroid is in the dead zone."""
    return F.when((x0 < ref_x) & (x1 > ref_x), "center").when(F.abs(cx - ref_x) <= dead_zone * width, "center").when(cx < ref_x, "left").otherwise("right")


def softmax(score: Column, over: WindowSpec, temperature: float) -> Column:
    """Softmax inside a partition; exponents are cut at -40."""
    e = F.exp(F.greatest((score - F.max(score).over(over)) / temperature, F.lit(-40.0)))
    return e / F.sum(e).over(over)


def min_max(score: Column, over: WindowSpec) -> Column:
    """Min-max normal form inside a partition, one half if all are equal."""
    lo, hi = F.min(score).over(over), F.max(score).over(over)
    return F.when(hi - lo < 1e-12, 0.5).otherwise((score - lo) / (hi - lo))


def hash_fraction(value: Column, seed: str) -> Column:
    """Stable number in [0, 1): the first 64 bits of sha256(seed:value)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)
    hi = F.conv(F.substring(h, 1, 8), 16, 10).cast("double")
    lo = F.conv(F.substring(h, 9, 8), 16, 10).cast("double")
    return (hi * 4294967296.0 + lo) / 18446744073709551616.0


def version_at_least(version: Column, least: str) -> Column:
    """Compare the first three dotted numbers, absent ones 0; versions that don't parse are older than any."""
    want = [int(x) for x in [*least.split("."), "0", "0"][:3]]
    part = lambda k: F.coalesce(F.try_element_at(F.split(version, "\\."), F.lit(k)), F.lit("0")).try_cast("int")
    ok = part(1).isNotNull() & part(2).isNotNull() & part(3).isNotNull()
    return F.when(ok, F.struct(*(part(k).alias(f"v{k}") for k in (1, 2, 3))) >= F.struct(*(F.lit(w).alias(f"v{k + 1}") for k, w in enumerate(want)))).otherwise(False)


def threshold_key(value: Column) -> Column:
    return F.lpad(F.bround(value * 100).cast("int").cast("string"), 3, "0")


def two_digits(number: Column) -> Column:
    """At least two digits; longer numbers stay whole."""
    return F.format_string("%02d", number)


def numbered(prefix: Column, partition: list[str], order: list) -> Column:
    """``prefix-01``, ``prefix-02``, ... inside a partition."""
    return F.concat(prefix, F.lit("-"), two_digits(F.row_number().over(Window.partitionBy(*partition).orderBy(*order))))


def root_label(origin: Column, index: Column, missing: str | None = None) -> Column:
    """Key of a root for reports: absent origins are ``legacy``; without an index null, or ``missing`` in its place."""
    at = index.cast("string") if missing is None else F.coalesce(index.cast("string"), F.lit(missing))
    return F.concat(F.coalesce(origin, F.lit("legacy")), F.lit("::"), at)


#: Endings of names that own broad surfaces.
_BROAD = "_(base_panel|body|frame|housing|panel|receiver|shell|surface|torso)$"


def broad_host(name: Column) -> Column:
    return name.rlike(_BROAD)


def broad_scene_layer(role: Column, derived: Column, area_share: Column) -> Column:
    """A scene layer that comes from the background or covers much of the image."""
    return F.coalesce((role == "scene_layer") & (F.coalesce(derived, F.lit(False)) | (F.coalesce(area_share, F.lit(0.0)) >= 0.24)), F.lit(False))


def dedup_quality(score: Column, reliability: Column, mask_quality: Column, dense: list[Column], contrast: list[Column]) -> Column:
    """Rank of alternate masks of one source; dense evidence takes part where there is any. The weights."""
    most = lambda cs: F.greatest(*cs, F.lit(None).cast("double"))  # noqa: E731  (nulls are passed over)
    base = clip((0.45 + 0.55 * clip(score, 0.0, 1.0)) * reliability, 0.0, 1.0)
    own = clip(F.coalesce(mask_quality, F.lit(0.5)), 0.0, 1.0)
    edge = clip(F.coalesce(most(contrast), F.lit(0.0)) / 0.12, 0.0, 1.0)
    return F.when(most(dense).isNull(), 0.72 * base + 0.28 * own).otherwise(0.34 * base + 0.22 * own + 0.22 * clip(most(dense), 0.0, 1.0) + 0.22 * edge)


def visibility_sliver(visible: Column, whole: Column, image: Column, least_area: int, most_image_share: float, least_share: float) -> Column:
    """A visible rest that is small in the image and a small share of its object."""
    small = visible < F.greatest(F.lit(4 * least_area), F.bround(image * most_image_share))
    return (visible > 0) & (whole > 0) & small & (visible / whole < least_share)


def area_prior(share: Column, lo: Column, hi: Column) -> Column:
    """1 inside the expected range of area shares, falling in proportion outside."""
    return F.when(share.between(lo, hi), 1.0).when(share < lo, F.greatest(F.lit(0.0), share / F.greatest(lo, F.lit(1e-8)))).otherwise(F.greatest(F.lit(0.0), hi / F.greatest(share, F.lit(1e-8))))


def image_box(box: Column, system: Column, width: Column, height: Column) -> Column:
    """Whole-pixel box (x0, y0, x1, y1) inside the image of four numbers in pixels or thousandths; null if it is empty,
    incomplete, not finite or of another system."""
    ok = (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & system.isin("normalized_1000", "pixels")
    at = lambda k, side: F.greatest(F.lit(0), F.least(side, F.bround(F.get(box, k) * F.when(system == "pixels", 1.0).otherwise(side / 1000.0)).cast("int")))
    out = F.struct(at(0, width).alias("x0"), at(1, height).alias("y0"), at(2, width).alias("x1"), at(3, height).alias("y1"))
    return F.when(ok & (out["x1"] > out["x0"]) & (out["y1"] > out["y0"]), out)
