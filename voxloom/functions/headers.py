"""Scalar functions over header fields: text, numbers, dates and hints as Columns."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_lower(c: Column) -> Column:
    """Trimmed, white space collapsed, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def upper_list(c: Column) -> Column:
    """Parts between backslashes, carets, commas, semicolons and spaces, in upper case; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\\^,; ]+"), F.upper), lambda x: x != "")


def safe_int(c: Column) -> Column:
    """A whole number or null; "256.0" is none."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("long"))


def safe_float(c: Column) -> Column:
    """A finite number or null."""
    v = F.trim(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def first_nonzero(*columns: Column) -> Column:
    """The first value that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in columns])


def parse_dt(*pairs: tuple[Column, Column]) -> Column:
    """The first valid date (yyyymmdd) and time (hhmmss with a fraction) of the pairs.

    A time is padded with zeros on the left to six digits; without one it is midnight.
    """

    def one(date: Column, time: Column) -> Column:
        time = F.coalesce(blank_to_null(F.trim(time)), F.lit("0"))
        whole, part = F.substring_index(time, ".", 1), F.when(time.contains("."), F.substring_index(time, ".", -1)).otherwise("")
        good = F.trim(date).rlike(r"^\d{8}$") & whole.rlike(r"^\d{1,6}$") & part.rlike(r"^\d*$")
        text = F.concat(F.trim(date), F.lpad(whole, 6, "0"), F.lit("."), F.rpad(part, 6, "0"))
        return F.when(good, F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss.SSSSSS")).cast("timestamp_ntz"))

    return F.coalesce(*[one(d, t) for d, t in pairs])


#: Where a b-value may stand, in order of preference.
B_VALUE_TAGS = ["DiffusionBValue", "DiffusionBFactor", "Philips_b_value", "Private_0019_100c", "Private_0043_1039", "Private_2001_1003"]


def b_value(tags: Column) -> Column:
    """The first readable b-value of a map of tags: of a vector the last number, else the number itself."""

    def read(v: Column) -> Column:
        numbers = F.filter(F.split(v, r"[\\,;\s]+"), lambda x: x.rlike(r"^[\d.]+$"))
        last = F.try_element_at(numbers, F.lit(-1)).try_cast("double")
        return F.when(v.rlike(r"[\\ ,;]"), last).otherwise(v.try_cast("double"))

    return F.coalesce(*[read(F.try_element_at(tags, F.lit(t))) for t in B_VALUE_TAGS])


def vendor_hints(tags: Column) -> dict[str, Column]:
    """Optional hints of a map of tags by name; each may be null."""
    get = lambda t: F.try_element_at(tags, F.lit(t))
    plain = {
        "manufacturer": "Manufacturer", "scanning_sequence": "ScanningSequence", "sequence_variant": "SequenceVariant", "scan_options": "ScanOptions", "mr_acq_type": "MRAcquisitionType",
        "contrast_agent": "ContrastBolusAgent", "contrast_volume": "ContrastBolusVolume", "acquisition_contrast": "AcquisitionContrast",
    }
    out = {name: get(tag) for name, tag in plain.items()}
    return out | {"pulse_sequence_name": F.coalesce(blank_to_null(get("PulseSequenceName")), get("SequenceName")), "b_value": b_value(tags)}


def median_of(values: Column, most: int) -> Column:
    """Median of the first `most` values that are not null; null without any."""
    held = F.array_sort(F.slice(F.filter(values, lambda x: x.isNotNull()), 1, most))
    n = F.size(held)
    return F.when(n > 0, (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2)


def pixel_spacing(own: Column, shared: Column, frames: Column, detector: Column, files: Column) -> Column:
    """The file's own spacing, else that shared by its frames, else the median of its first 100 frames, else the detector's, else the median of 50 files."""
    return F.coalesce(own, shared, median_of(frames, 100), detector, median_of(files, 50))


def _listed(groups: Column, tag: str, most: int) -> Column:
    return F.transform(F.slice(groups, 1, most), lambda g: F.try_element_at(g, F.lit(tag)))


#: Frames of a file whose spacing and type, and whose thickness, are looked at.
SPACING_FRAMES, SLICE_FRAMES = 100, 200


def file_spacing(tags: Column, shared: Column, frames: Column) -> Column:
    """(row, column) spacing of one file: its own, that shared by its frames, the median of its frames, the detector's; nulls without any."""
    pair = lambda text: F.transform(F.split(text, r"\\"), safe_float)
    whole = lambda text: F.when((F.get(pair(text), 0).isNotNull()) & (F.get(pair(text), 1).isNotNull()), pair(text))
    own, both, detector = (whole(F.try_element_at(m, F.lit(t))) for m, t in ((tags, "PixelSpacing"), (shared, "PixelSpacing"), (tags, "ImagerPixelSpacing")))
    each = F.filter(F.transform(_listed(frames, "PixelSpacing", SPACING_FRAMES), whole), lambda x: x.isNotNull())
    part = lambda k: pixel_spacing(F.get(own, k), F.get(both, k), F.transform(each, lambda x: F.get(x, k)), F.get(detector, k), F.array().cast("array<double>"))
    return F.array(part(0), part(1))


def slice_metrics(tags: Column, shared: Column, frames: Column) -> dict[str, Column]:
    """thickness and between (distance of slices): the file's own, else shared, else the median of its frames; frames: their number."""

    def found(tag: str) -> Column:
        each = F.transform(_listed(frames, tag, SLICE_FRAMES), safe_float)
        return F.coalesce(safe_float(F.try_element_at(tags, F.lit(tag))), safe_float(F.try_element_at(shared, F.lit(tag))), median_of(each, SLICE_FRAMES))

    return {"thickness": found("SliceThickness"), "between": found("SpacingBetweenSlices"), "frames": safe_int(F.try_element_at(tags, F.lit("NumberOfFrames")))}


def image_flags(tags: Column, shared: Column, frames: Column) -> Column:
    """Sorted distinct image and frame types of the file, the groups shared by its frames and its frames, in upper case."""
    one = lambda m, t: upper_list(F.try_element_at(m, F.lit(t)))
    each = F.flatten(F.transform(_listed(F.coalesce(frames, F.array().cast("array<map<string,string>>")), "FrameType", SPACING_FRAMES), upper_list))
    return F.array_sort(F.array_distinct(F.concat(one(tags, "ImageType"), one(tags, "FrameType"), one(shared, "FrameType"), each)))


def primary_secondary(types: Column) -> Column:
    return F.when(F.array_contains(types, "PRIMARY"), "PRIMARY").when(F.array_contains(types, "SECONDARY"), "SECONDARY")


def iso_time(when: Column) -> Column:
    """yyyy-mm-ddThh:mm:ss with six digits of a fraction where there is one."""
    return F.regexp_replace(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.0+$", "")


def matrix(columns: Column, rows: Column) -> Column:
    mark = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(mark(columns), F.lit("x"), mark(rows))


def voxel_mm(x: Column, y: Column, z: Column) -> Column:
    """Sizes with two decimals, without z where it is null; null without x or y."""
    text = F.when(z.isNull(), F.format_string("%.2fx%.2f", x, y)).otherwise(F.format_string("%.2fx%.2fx%.2f", x, y, z))
    return F.when(x.isNotNull() & y.isNotNull(), text)


def series_dirname(number: Column, description: Column, uid: Column) -> Column:
    """Number (0), description (Series) with runs of other than word characters and hyphens as one _, and six digits of the uid's SHA-1."""
    safe = blank_to_null(F.regexp_replace(F.trim(F.coalesce(description, F.lit(""))), r"(?U)[^\w\-]+", "_"))
    return F.concat_ws("_", F.coalesce(number, F.lit(0)).cast("string"), F.coalesce(safe, F.lit("Series")), F.substring(F.sha1(uid), 1, 6))


def file_field(name: Column, k: int, given: Column | None = None) -> Column:
    """Field k of a file name between underscores, unless another value is given; too few fields are an error."""
    field = F.get(F.split(name, "_"), k)
    checked = F.when(field.isNull(), F.raise_error(F.concat(F.lit("too few fields: "), name))).otherwise(field)
    return checked if given is None else F.coalesce(given, checked)


def replace_first_of(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The first text of the rules that occurs is replaced wherever it occurs."""
    out = name
    for old, new in reversed(rules):
        out = F.when(name.contains(old), F.replace(name, F.lit(old), F.lit(new))).otherwise(out)
    return out


def path_parts(path: Column) -> dict[str, Column]:
    """folder, name and ext (with its dot, lower case) of a path."""
    name = F.substring_index(path, "/", -1)
    return {"folder": F.regexp_extract(path, "^(.*)/[^/]*$", 1), "name": name, "ext": F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))}


def parse_class_map(text: str | None) -> dict[tuple[int, ...], object]:
    """A literal dictionary with tuples of classes as keys; empty for nothing, None, null, nan or {}. Nothing is evaluated."""
    if text is None or text.strip().lower() in ("", "none", "null", "nan", "{}"):
        return {}
    found = ast.literal_eval(text)
    if not isinstance(found, dict) or not all(isinstance(k, tuple) for k in found):
        raise ValueError(f"not a map with tuples as keys: {text}")
    return found


def any_of(hits: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, hits, F.lit(False))
