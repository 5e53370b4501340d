"""Series metadata: classification rules as data, exam-level inference, nearest-in-time lookup, catalog and demix plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Plane and base-type rules, first hit wins: (pattern on the name tokens, label).
PLANE_RULES = [(r"\b(ax|axial)\b", "AX"), (r"\b(sag|sagittal)\b", "SAG"), (r"\b(cor|coronal)\b", "COR"), (r"\btra\b", "AX"), ("obl", "OBL")]
BASE_RULES = [
    ("localizer|scout|loc", "Localizer"), ("dwi|diff|ep2d|ep b|trace", "DWI"), ("swi|swan|suscept|venogr", "SWI"),
    ("perfusion|pwi|dsc|dce|asl|pcasl", "Perfusion"), ("flair", "T2f"), ("t2", "T2w"), ("t1|mprage|bravo|spgr|vibe", "T1"),
]
POST = r"post|c\+|gad|with contrast|w/ contrast|t1c"
#: Patterns of the cascade, and its categories: (pattern on the name tokens, image type, label), first hit wins.
LOCALIZER = "localizer|scout|aahead|a ahead|3 plane|3plane|loc"
PERFUSION = "perfusion|pwi|dsc|dce|asl|pcasl"
PROJECTION = r"\bmip\b|\bminip\b|project|slab"
FSPGR = "fspgr|spgr|bravo|mprage|mp rage|vibe|spoiled|t1 cube|t1cube|tfl3d|tfl"
DERIVED = ["DERIVED", "SECONDARY", "REFORMATTED", "RESAMPLED", "MPR", "MIP", "MINIP", "T2_STAR", "TRACEW", "ADC", "FA", "EXP_ATTEN", "AVDC", "AVERAGE", "MINIMUM", "MAXIMUM", "SUBTRACTION"]
DWI_CATEGORIES = [("adc", "ADC", "ADC"), (r"\bfa\b", "FA", "FA"), ("trace|isotropic", "ISO", "TRACE"), ("avdc", None, "AvDC"), ("exp atten|expatten", None, "EXP_ATTEN")]
SWI_CATEGORIES = [("min ip|minip", "MINIP", "MINIP"), ("mip", "MIP", "MIP"), ("pha", "PHASE", "PHASE"), ("mag", "MAGNITUDE", "MAG"), ("qsm", None, "QSM")]
PERFUSION_CATEGORIES = [
    *((k, None, k.upper()) for k in ("cbv", "cbf", "mtt", "ttp", "tmax", "ktrans")), ("k trans", None, "KTRANS"), ("kep", None, "KEP"), ("ve", None, "VE"), ("vp", None, "VP"),
    ("leakage", None, "LEAKAGE"), ("parametric", None, "PARAM_MAP"), ("pbp", None, "PBP"), ("gbp", None, "GBP"), (None, "MIP", "PROJECTION"), (None, "MINIP", "PROJECTION"),
]


def name_tokens(*columns: Column) -> Column:
    """Joined, white space collapsed, lower case, _ and - as spaces."""
    joined = F.trim(F.regexp_replace(F.concat_ws(" ", *columns), r"\s+", " "))
    return F.regexp_replace(F.lower(joined), "[_-]+", " ")


def person_name(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(c, r"\^", " "), r"[^A-Za-z0-9\s']", " ")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def first_rule(tokens: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(tokens.rlike(pattern), label).otherwise(out)
    return out


def _localizer_subtype(t: Column) -> Column:
    return first_rule(t, [(r"\bmpr ?sag\b", "MPR_SAG"), (r"\bmpr ?cor\b", "MPR_COR"), (r"\bmpr ?tra\b", "MPR_TRA"), (r"(?<![a-z])mpr\b", "MPR")])


def category(t: Column, types: Column, rules: list[tuple[str | None, str | None, str]]) -> Column:
    """First hit of (pattern on the name, image type, label)."""
    out = F.lit(None).cast("string")
    for pattern, kind, label in reversed(rules):
        hit = (t.rlike(pattern) if pattern else F.lit(False)) | (F.array_contains(types, kind) if kind else F.lit(False))
        out = F.when(hit, label).otherwise(out)
    return out


def is_derived(t: Column, types: Column, cat: Column) -> Column:
    """Image types decide where there are any, else a category or a projection's name."""
    marked = F.arrays_overlap(types, F.array(*[F.lit(x) for x in DERIVED]))
    return F.when(F.size(types) > 0, marked).otherwise(cat.isNotNull() | t.rlike(PROJECTION))


#: What classify() reads besides `tokens`, `te` and `tr`; a column that is missing counts as null.
CONTEXT = {
    "exam": "string", "acq_dt": "timestamp", "b_value": "double", "image_types": "array<string>", "plane": "string", "pulse_sequence_name": "string",
    "sequence_name": "string", "protocol_name": "string", "contrast_agent": "string", "acquisition_contrast": "string",
}


def classify(series: DataFrame) -> DataFrame:
    """Adds base_type, final_label, is_postcontrast, is_flair, is_derived, confidence and reason: the rule cascade.

    Reads `tokens`, te, tr and those of CONTEXT. The inferred contrast time is that of the `exam`; series of a null exam have none.
    """
    own = series.columns
    full = series.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in CONTEXT.items() if c not in own])
    full = full.withColumn("_t", F.coalesce("tokens", F.lit("")))
    t = F.col("_t")
    full = full.join(contrast_time(full.select("exam", "acq_dt", "_t"), "exam", "acq_dt", t.rlike(PERFUSION), t.rlike(POST)).select("exam", F.col("t0").alias("_t0")).distinct(), "exam", "left")
    full = full.withColumn("_late", F.coalesce(F.col("acq_dt") > F.col("_t0"), F.lit(False)))
    clean = F.filter(F.transform("image_types", lambda x: F.upper(F.trim(x))), lambda x: x != "")
    full = full.withColumn("_k", F.coalesce(F.array_sort(F.array_distinct(clean)), F.array().cast("array<string>")))
    types, none = F.col("_k"), F.array().cast("array<string>")

    dwi = category(t, types, DWI_CATEGORIES)
    generic = t.rlike("swi|swan") & ~t.rlike("pha|mag|min ip|mip|minip")
    swi = F.when(~generic, F.coalesce(category(t, none, SWI_CATEGORIES), category(F.lit(""), types, SWI_CATEGORIES)))
    nothing = F.lit(None).cast("string")
    te, tr = F.col("te"), F.col("tr")
    rules = [
        t.rlike(LOCALIZER), dwi.isNotNull() | t.rlike("dwi|diff|ep2d|ep b|trace") | (F.col("b_value") > 0), t.rlike("swi|swan|suscept|venogr"), t.rlike(PERFUSION), t.rlike("flair"),
        t.rlike("t2"), t.rlike("t1|mprage|bravo|spgr|vibe"), (te >= 80) & (tr >= 2000), (te > 0) & (te <= 20) & (tr > 0) & (tr <= 1000),
    ]
    rule = F.lit(10)
    for n in range(len(rules), 0, -1):
        rule = F.when(rules[n - 1], n).otherwise(rule)
    full = full.withColumn("_r", rule)

    def by_rule(values: dict, otherwise: Column) -> Column:
        out = otherwise
        for n, v in values.items():
            out = F.when(F.col("_r") == n, v).otherwise(out)
        return out

    t1 = first_rule(t, [("mip", "MIP"), ("minip", "MINIP")])
    full = full.withColumn("_c", by_rule({1: _localizer_subtype(t), 2: dwi, 3: swi, 4: category(t, types, PERFUSION_CATEGORIES), 7: t1}, nothing))
    c, late = F.col("_c"), F.col("_late")
    named = t.rlike(POST)
    vendor = (F.coalesce("contrast_agent", F.lit("")) != "") | F.coalesce(F.upper("acquisition_contrast").contains("CONTRAST"), F.lit(False))
    post = by_rule({7: named | vendor | late, 9: late}, F.lit(False))
    base = by_rule({1: "Localizer", 2: "DWI", 3: "SWI", 4: "Perfusion", 5: "T2f", 6: "T2w", 7: "T1", 8: "T2w", 9: "T1"}, nothing)
    full = full.withColumn("base_type", base).withColumn("is_postcontrast", post).withColumn("is_flair", F.col("_r") == 5).withColumn("is_derived", is_derived(t, types, c))
    label = F.when(F.col("base_type") == "T1", F.when(F.col("is_postcontrast"), "T1c").otherwise("T1n")).when(F.col("base_type") == "T2f", "T2-FLAIR")
    label = label.otherwise(F.coalesce("base_type", F.when(F.col("is_derived"), "Unknown-derived").otherwise("Unknown")))
    label = F.when(c.isNull(), label).otherwise(F.concat(label, F.lit("("), c, F.lit(")")))

    fast = F.concat_ws(" ", t, F.lower("sequence_name"), F.lower("protocol_name")).rlike(FSPGR)
    either = lambda plain, more: F.when(c.isNull(), plain).otherwise(more)
    by_t1 = F.when(fast, 0.85).when(F.col("is_postcontrast"), 0.8).otherwise(0.7)
    confidence = by_rule({1: either(0.9, 0.95), 2: either(0.9, 0.95), 3: either(0.9, 0.95), 4: either(0.85, 0.9), 5: 0.9, 6: 0.8, 7: by_t1, 8: 0.7, 9: 0.65}, F.lit(0.3))
    yes = F.when(F.col("is_derived"), "True").otherwise("False")
    family = lambda name: F.concat(F.lit(f"{name} family; derived="), yes, F.lit("; dcat="), F.coalesce(c, F.lit("None")))
    times = lambda kind: F.concat(F.lit(f"TE/TR suggest {kind} (TE="), te.cast("string"), F.lit(", TR="), tr.cast("string"), F.lit(")"))
    agent = F.concat(F.lit("vendor contrast present (agent='"), F.coalesce("contrast_agent", F.lit("")), F.lit("' or AcquisitionContrast)"))
    why_post = F.when(named, "explicit post-contrast tokens").when(vendor, agent).when(late, "acquired after inferred contrast time")
    evidence = {1: F.concat(F.lit("Localizer family; subtype="), F.coalesce(c, F.lit("None"))), 2: family("DWI"), 3: family("SWI"), 4: family("Perfusion"), 5: "FLAIR in name", 6: "T2 token", 7: why_post, 8: times("T2"), 9: times("T1")}
    seen = {"plane": "plane", "PulseSequenceName": "pulse_sequence_name", "b_value": "b_value"}
    reason = F.concat_ws(
        "; ",
        F.when(F.size(types) > 0, F.concat(F.lit("ImageType="), F.array_join(types, ","))),
        *[F.concat(F.lit(f"{name}="), F.col(x).cast("string")) for name, x in seen.items()],
        F.when((F.col("_r") == 3) & t.contains("swan"), "SWI subtype=SWAN"),
        by_rule(evidence, F.lit("No strong name/physics cues")),
        F.when((F.col("_r") == 7) & fast, "FSPGR-like sequence"),
        F.when((F.col("_r") == 9) & late, "timing upgrade to post-contrast"),
    )
    return full.select(*own, "base_type", label.alias("final_label"), "is_postcontrast", "is_flair", "is_derived", confidence.alias("confidence"), reason.alias("reason"))


def contrast_time(series: DataFrame, exam: str, time: str, perfusion: Column, post: Column) -> DataFrame:
    """Adds t0, the exam's first perfusion time or else its first post time, and is_after (strict, null is false).

    One row an exam is aggregated first and joined back, so a huge exam is no window partition.
    """
    t0 = series.groupBy(exam).agg(F.coalesce(F.min(F.when(perfusion, F.col(time))), F.min(F.when(post, F.col(time)))).alias("t0"))
    return series.join(t0, exam, "left").withColumn("is_after", F.coalesce(F.col(time) > F.col("t0"), F.lit(False)))


def nearest(series: DataFrame, keys: list[str], time: str, row_id: str, derived: Column, value: str, name: str) -> DataFrame:
    """Each derived row with `name`: `value` of the row nearest in time, not derived and of equal keys; ties: least id.

    The last candidate so far in time order and in the reverse order; the equal keys are never joined with one another.
    """
    order = Window.partitionBy(*keys).orderBy(time, row_id)
    reverse = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(row_id))
    seen = F.when(~derived, F.struct(F.col(time).alias("t"), F.col(row_id).alias("i"), F.col(value).alias("v")))
    at = lambda c: c["t"].cast("timestamp").cast("double")
    now = F.col(time).cast("timestamp").cast("double")
    before = F.last(seen, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(seen, True).over(reverse.rowsBetween(Window.unboundedPreceding, -1))
    out = series.withColumn("_d", derived).withColumn("_b", before).withColumn("_a", after)
    gap_b, gap_a = F.abs(now - at(F.col("_b"))), F.abs(at(F.col("_a")) - now)
    pick_b = F.col("_a").isNull() | (gap_b < gap_a) | ((gap_b == gap_a) & (F.col("_b.i") < F.col("_a.i")))
    chosen = F.when(F.col("_b").isNotNull() & pick_b, F.col("_b.v")).otherwise(F.col("_a.v"))
    return out.where("_d").withColumn(name, chosen).drop("_d", "_b", "_a")


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: * and ? stand for any characters, [..] for one of a set, [!..] for one outside it."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        stop = pattern.find("]", i + 2) if c == "[" else -1
        if stop > 0:
            inner = pattern[i + 1 : stop].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = stop
        else:
            out.append({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else "\\" + c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def matches(path: Column, pattern: str) -> Column:
    """A glob where the pattern holds any of * ? [ ], else a literal substring."""
    if any(c in pattern for c in "*?[]"):
        return path.rlike(glob_regex(pattern))
    return path.contains(pattern)


def z_spacing(slices: DataFrame, series: str, iop: Column, ipp: Column) -> DataFrame:
    """series, z_spacing: median of the positive gaps of positions along the mean unit normal; at least two positions are needed."""
    u = F.array(*[F.get(iop, k) for k in range(6)])
    cross = [F.get(u, a) * F.get(u, b) - F.get(u, c) * F.get(u, d) for a, b, c, d in ((1, 5, 2, 4), (2, 3, 0, 5), (0, 4, 1, 3))]
    rows = slices.select(series, ipp.alias("_p"), *[c.alias(f"_n{k}") for k, c in enumerate(cross)])
    size = F.sqrt(sum(F.col(f"_n{k}") * F.col(f"_n{k}") for k in range(3)))
    mean = rows.groupBy(series).agg(*[F.avg(F.try_divide(F.col(f"_n{k}"), size)).alias(f"_m{k}") for k in range(3)])
    length = F.sqrt(sum(F.col(f"_m{k}") * F.col(f"_m{k}") for k in range(3)))
    along = sum(F.get("_p", k) * F.try_divide(F.col(f"_m{k}"), length) for k in range(3))
    placed = rows.join(mean, series).select(series, along.alias("_z"))
    gap = F.col("_z") - F.lag("_z").over(Window.partitionBy(series).orderBy("_z"))
    return placed.select(series, gap.alias("_d")).where("_d > 0").groupBy(series).agg(F.median("_d").alias("z_spacing"))


def exactly_one(files: DataFrame, folder: str, path: str, patterns: dict[str, str]) -> DataFrame:
    """Folders in which each pattern matches exactly one file, with that file under the pattern's name."""
    aggs = [a for n, p in patterns.items() for a in (F.count_if(matches(F.col(path), p)).alias(f"_n_{n}"), F.min(F.when(matches(F.col(path), p), F.col(path))).alias(n))]
    out = files.groupBy(folder).agg(*aggs)
    for n in patterns:
        out = out.where(F.col(f"_n_{n}") == 1).drop(f"_n_{n}")
    return out


def demix_counts(files: DataFrame, parent: str, leaf: str, key: str) -> DataFrame:
    """parent, leaf, key, n, and total: the key's files in the parent; leaf_keys: keys of the leaf, key_leaves: leaves of the key."""
    n = files.groupBy(parent, leaf, key).agg(F.count("*").alias("n"))
    by_key, by_leaf = Window.partitionBy(parent, key), Window.partitionBy(parent, leaf)
    return n.withColumn("total", F.sum("n").over(by_key)).withColumn("key_leaves", F.count("*").over(by_key)).withColumn("leaf_keys", F.count("*").over(by_leaf))


def demix_key(readable: Column, uid: Column, number: Column, description: Column, protocol: Column) -> Column:
    """What tells a file's series: its UID, else number (-1 without one), description and protocol, else one key for all unreadable files."""
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    fallback = F.concat_ws("|", F.lit("FALLBACK"), F.coalesce(number, F.lit(-1)).cast("string"), text(description), text(protocol))
    by_uid = F.when(F.coalesce(uid, F.lit("")) != "", F.concat(F.lit("UID|"), uid)).otherwise(fallback)
    return F.when(F.coalesce(readable, F.lit(False)), by_uid).otherwise("UNKNOWN")


def demix_greedy(counts: DataFrame, parent: str, leaf: str, key: str) -> DataFrame:
    """Pairs taken by falling n, then leaf, then key, while both are free: a fold over the ordered pairs of each parent.

    A parent's distinct pairs of leaf and key meet in one row; its files do not.
    """
    kinds = {f.name: f.dataType.simpleString() for f in counts.select(leaf, key).schema}
    pair = F.struct((-F.col("n")).alias("o"), F.col(leaf).alias("l"), F.col(key).alias("k"))
    ordered = counts.groupBy(parent).agg(F.sort_array(F.collect_list(pair)).alias("_pairs"))
    none = F.expr(f"CAST(array() AS array<struct<o:bigint,l:{kinds[leaf]},k:{kinds[key]}>>)")
    clash = lambda taken, p: F.exists(taken, lambda t: (t["l"] == p["l"]) | (t["k"] == p["k"]))
    taken = F.aggregate("_pairs", none, lambda taken, p: F.when(clash(taken, p), taken).otherwise(F.array_append(taken, p)))
    return ordered.select(parent, F.explode(taken).alias("p")).select(parent, F.col("p.l").alias(leaf), F.col("p.k").alias(key), (-F.col("p.o")).alias("n"))


def demix_moves(counts: DataFrame, parent: str, leaf: str, key: str) -> DataFrame:
    """parent, leaf, key, n and target: the leaf that is to hold all files of the key, null where a new one is needed.

    A leaf of one key that holds all of it keeps it; other keys and leaves are matched greedily.
    """
    pure = counts.where("leaf_keys = 1 and n = total").select(parent, leaf, key)
    rest = counts.join(pure.select(parent, leaf), [parent, leaf], "left_anti").join(pure.select(parent, key), [parent, key], "left_anti")
    held = pure.unionByName(demix_greedy(rest, parent, leaf, key).select(parent, leaf, key)).withColumnRenamed(leaf, "target")
    return counts.select(parent, leaf, key, "n").join(held, [parent, key], "left").select(parent, leaf, key, "n", "target")


def demix_targets(moves: DataFrame, parent: str, leaf: str, key: str, base: Column) -> DataFrame:
    """The moves with `folder`: the name of the target leaf, or of a new one by `base` (of parent and key).

    Where a leaf or an earlier new folder (by key) of the parent has that name, the first free one of base-2, base-3, ... is taken.
    """
    fresh = F.when(F.col("target").isNull(), F.struct(base.alias("b"), F.col(key).alias("k")))
    by_parent = moves.groupBy(parent).agg(F.collect_set(F.col(leaf).cast("string")).alias("_there"), F.sort_array(F.collect_set(fresh)).alias("_new"))
    name = lambda b, k: F.when(k == 1, b).otherwise(F.concat(b, F.lit("-"), k.cast("string")))

    def named(there: Column, new: Column, x: Column, i: Column) -> Column:
        place = F.size(F.filter(F.slice(new, F.lit(1), i + 1), lambda y: y["b"] == x["b"]))
        names = F.transform(F.sequence(F.lit(1), place + F.size(there)), lambda k: name(x["b"], k))
        return F.struct(x["k"].alias("k"), F.get(F.filter(names, lambda n: ~F.array_contains(there, n)), place - 1).alias("folder"))

    made = by_parent.select(parent, F.explode(F.transform("_new", lambda x, i: named(F.col("_there"), F.col("_new"), x, i))).alias("m"))
    made = made.select(parent, F.col("m.k").alias(key), F.col("m.folder").alias("_made"))
    return moves.join(made, [parent, key], "left").withColumn("folder", F.coalesce(F.col("target").cast("string"), "_made")).drop("_made")
