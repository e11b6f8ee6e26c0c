"""Advisory work: defects, drafts from advisory exports, version ranges, dependency audit, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import versions as V
from ..functions.ranking import range_offsets, sorted_places
from ..functions.text import LB, RB
from ..session import cut_lineage
from .records import FACTS_ONLY, _strings, has_prefix, has_vuln_prefix, is_advisory, own_signals

# Id patterns, blocking flag prefixes, audited scope defects, audit prefixes,
# ecosystem-to-runtime names.
VULN_ID = r"(?i)(GHSA-[0-9a-z]{4,}-[0-9a-z]{4,}-[0-9a-z]{4,}|CVE-\d{4}-\d+|GO-\d{4}-\d+)"
GHSA_ID = rf"(?i){LB}GHSA-[0-9a-z]{{4}}-[0-9a-z]{{4}}-[0-9a-z]{{4}}{RB}"
BLOCKING_PREFIXES = (
    "consistency:null-fixed-fix-text",
    "consistency:malformed-package-path",
    "consistency:source-url-id-mismatch",
    "consistency:ecosystem-package-mismatch",
    "consistency:go-major-version-path",
    "consistency:go-module-path-case",
)
SCOPE_DEFECTS = (
    ("GHSA-22FX-6R9M-R8H9", "Go", "github.com/strukturag/libheif", "consistency:ecosystem-package-mismatch"),
    ("GHSA-4V48-4Q5M-8VX4", "Go", "github.com/prometheus/prometheus/v2", "consistency:go-major-version-path"),
    ("GHSA-7V4P-328V-8V5G", "Go", "github.com/traefik/traefik", "consistency:go-major-version-path"),
    ("GHSA-FPW6-HRG5-Q5X5", "Go", "github.com/lin-snow/Ech0", "consistency:go-module-path-case"),
)
AUDIT_PREFIXES = ("GHSA-", "CVE-", "GO-", "MAL-", "RUSTSEC-")
RUNTIME_PRODUCTS = {"go": "go", "npm": "nodejs", "pypi": "python"}
# The generated texts of advisory drafts.
OSV_URL = "https://osv.dev/vulnerability/%s"
DRAFT_TITLE = "%s: vulnerability in %s"
DRAFT_SUMMARY = "%s: known vulnerability in %s"
DRAFT_ROOT_CAUSE = "Known vulnerability documented in OSV advisory %s."
DRAFT_FIX = "Upgrade affected packages past the fixed version; see %s."
DRAFT_NO_FIX = (
    "No fix is published yet (the advisory lists no fixed version); see %s for status and mitigations."
)
DRAFT_BODY = "OSV advisory %s affects %s. See %s."

APPLIES = "array<struct<ecosystem:string,package:string,versions:struct<introduced:string,fixed:string>,runtime:map<string,string>>>"


def is_blocking_flag(flag: Column) -> Column:
    out = F.lit(False)
    for prefix in BLOCKING_PREFIXES:
        out = out | flag.startswith(prefix)
    return out


def defects_column() -> Column:
    """Deterministic transcription defects of an advisory record (empty for any other)."""
    applies = F.coalesce(F.col("applies_to"), F.array().cast(APPLIES))
    own = F.transform(F.filter(own_signals(), has_vuln_prefix), lambda s: F.upper(X.utrim(s)))
    fixed_known = F.exists(applies, lambda a: ~X.is_blank(a["versions"]["fixed"]))
    claims_fix = F.contains(F.lower(F.coalesce(F.col("resolution.fix"), F.lit(""))), F.lit("past the fixed version"))
    url_ids = F.regexp_extract_all(F.coalesce(F.col("provenance.source_url"), F.lit("")), F.lit(VULN_ID), F.lit(1))
    foreign = F.get(F.filter(url_ids, lambda i: ~F.array_contains(own, F.upper(i))), F.lit(0))

    def package_defects(a: Column) -> Column:
        pkg = F.coalesce(a["package"], F.lit(""))
        malformed = ~X.is_blank(pkg) & (F.contains(pkg, F.lit("://")) | pkg.rlike(r"[ \t\n]"))
        return F.array_compact(F.array(F.when(malformed, F.concat(F.lit("consistency:malformed-package-path:"), X.utrim(pkg)))))

    def scope_defects(a: Column) -> Column:
        pkg = F.coalesce(a["package"], F.lit(""))
        found = []
        for advisory, ecosystem, package, flag in SCOPE_DEFECTS:
            hit = (
                F.array_contains(own, advisory)
                & (F.lower(X.utrim(a["ecosystem"])) == ecosystem.lower())
                & (X.utrim(pkg) == package)
            )
            found.append(F.when(hit, F.lit(f"{flag}:{package}")))
        return F.array_compact(F.array(*found))

    general = F.array_compact(
        F.array(
            F.when(claims_fix & ~fixed_known, F.lit("consistency:null-fixed-fix-text")),
            F.when(foreign.isNotNull(), F.concat(F.lit("consistency:source-url-id-mismatch:"), foreign)),
        )
    )
    per_package = F.flatten(F.transform(applies, package_defects))
    # Several ranges of one package are one scope defect.
    scope = F.array_distinct(F.flatten(F.transform(applies, scope_defects)))
    return F.when(is_advisory(), F.concat(general, per_package, scope)).otherwise(F.array().cast("array<string>"))


def advisory_defects(records: DataFrame) -> DataFrame:
    """(id, flag, blocking): one row per defect."""
    return records.select("id", F.explode(defects_column()).alias("flag")).withColumn(
        "blocking", is_blocking_flag(F.col("flag"))
    )


def range_pairs(events: Column) -> Column:
    """Ordered introduced/fixed events -> disjoint intervals; an open start closes without a fix."""
    interval = "struct<introduced:string,fixed:string>"
    state = F.struct(
        F.array().cast(f"array<{interval}>").alias("pairs"),
        F.lit(None).cast("string").alias("cur"),
        F.lit(False).alias("open"),
    )

    def pair(introduced: Column, fixed: Column) -> Column:
        return F.array(F.struct(introduced.alias("introduced"), fixed.alias("fixed")))

    def step(acc: Column, e: Column) -> Column:
        none = F.lit(None).cast("string")
        intro, fixed = F.nullif(e["introduced"], F.lit("")), F.nullif(e["fixed"], F.lit(""))
        starts, ends = intro.isNotNull(), fixed.isNotNull()
        pairs = F.when(starts & acc["open"], F.concat(acc["pairs"], pair(acc["cur"], none))).otherwise(acc["pairs"])
        cur = F.when(starts, intro).otherwise(acc["cur"])
        return F.struct(
            F.when(ends, F.concat(pairs, pair(cur, fixed))).otherwise(pairs).alias("pairs"),
            F.when(ends, none).otherwise(cur).alias("cur"),
            F.when(ends, F.lit(False)).otherwise(acc["open"] | starts).alias("open"),
        )

    return F.aggregate(
        events,
        state,
        step,
        lambda acc: F.when(
            acc["open"], F.concat(acc["pairs"], pair(acc["cur"], F.lit(None).cast("string")))
        ).otherwise(acc["pairs"]),
    )


def pair_version_ranges(advisories: DataFrame) -> DataFrame:
    """(id, ecosystem, package, introduced, fixed) from OSV rows."""
    ranges = advisories.select("id", F.explode("affected").alias("a")).select(
        "id", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("package"),
        F.explode("a.ranges").alias("r"),
    )
    return ranges.select("id", "ecosystem", "package", F.inline(range_pairs(F.col("r.events"))))


def advisories_to_drafts(osv: DataFrame, ecosystem: str) -> DataFrame:
    """OSV rows -> draft rows in the record grammar (withdrawn, id-less and foreign ones dropped)."""

    def package_name(name: Column) -> Column:
        return X.utrim(F.regexp_replace(X.utrim(name), "^https?://", ""))

    mine = F.filter(
        F.col("affected"),
        lambda a: (F.substring_index(a["package"]["ecosystem"], ":", 1) == ecosystem)
        & (package_name(F.coalesce(a["package"]["name"], F.lit(""))) != ""),
    )

    def applies(a: Column) -> Column:
        def versions(iv: Column) -> Column:
            known = iv["introduced"].isNotNull() | iv["fixed"].isNotNull()
            return F.struct(
                F.lit(ecosystem).alias("ecosystem"),
                package_name(a["package"]["name"]).alias("package"),
                F.when(known, F.struct(iv["introduced"].alias("introduced"), iv["fixed"].alias("fixed"))).alias("versions"),
                F.lit(None).cast("map<string,string>").alias("runtime"),
            )

        whole = F.array(
            F.struct(F.lit(None).cast("string").alias("introduced"), F.lit(None).cast("string").alias("fixed"))
        )

        def of_range(r: Column) -> Column:
            pairs = range_pairs(F.coalesce(r["events"], F.array().cast("array<struct<introduced:string,fixed:string>>")))
            return F.transform(F.when(F.size(pairs) > 0, pairs).otherwise(whole), versions)

        return F.flatten(F.transform(a["ranges"], of_range))

    aliases = _strings("aliases")
    kept = osv.where(X.is_blank("withdrawn") & ~X.is_blank("id")).withColumn("_mine", mine)
    kept = kept.withColumn("applies_to", F.flatten(F.transform("_mine", applies))).where(F.size("applies_to") > 0)
    own = F.transform(F.concat(F.array("id"), aliases), lambda i: F.lower(X.utrim(i)))
    cites_own = lambda r: F.array_contains(own, F.lower(F.regexp_extract(r["url"], GHSA_ID, 0)))
    refs = F.coalesce(F.col("references"), F.array().cast("array<struct<type:string,url:string>>"))
    own_ref = F.get(F.filter(refs, lambda r: (F.regexp_extract(r["url"], GHSA_ID, 0) != "") & cites_own(r)), F.lit(0))
    kept = kept.withColumn("source_url", F.coalesce(own_ref["url"], F.format_string(OSV_URL, F.col("id"))))
    primary = package_name(F.get("_mine", F.lit(0))["package"]["name"])
    ids = F.when(F.size(aliases) > 0, F.concat("id", F.lit(" ("), F.array_join(aliases, ", "), F.lit(")"))).otherwise(
        F.col("id")
    )
    has_fix = F.exists("applies_to", lambda a: a["versions"]["fixed"].isNotNull())

    def span(a: Column) -> Column:
        intro, fixed = a["versions"]["introduced"], a["versions"]["fixed"]
        return F.concat(
            a["package"],
            F.when(
                intro.isNotNull(),
                F.concat(
                    F.lit(" (introduced "), intro,
                    F.when(fixed.isNotNull(), F.concat(F.lit(", fixed "), fixed)).otherwise(F.lit("")),
                    F.lit(")"),
                ),
            )
            .when(fixed.isNotNull(), F.concat(F.lit(" (fixed "), fixed, F.lit(")")))
            .otherwise(F.lit("")),
        )

    spans = F.array_join(F.transform("applies_to", span), "; ")
    return kept.select(
        F.col("id").alias("draft_id"),
        F.lit("trap").alias("kind"),
        F.format_string(DRAFT_TITLE, F.col("id"), primary).alias("title"),
        F.struct(
            F.format_string(DRAFT_SUMMARY, ids, primary).alias("summary"),
            F.concat(F.array("id"), aliases).alias("error_signatures"),
            F.lit(None).cast("struct<app:array<string>,generic:array<string>>").alias("fingerprints"),
        ).alias("symptom"),
        "applies_to",
        F.struct(
            F.format_string(DRAFT_ROOT_CAUSE, F.col("id")).alias("root_cause"),
            F.when(has_fix, F.format_string(DRAFT_FIX, F.col("source_url")))
            .otherwise(F.format_string(DRAFT_NO_FIX, F.col("source_url")))
            .alias("fix"),
            F.lit(None).cast("array<struct<tried:string,why_it_failed:string>>").alias("dead_ends"),
        ).alias("resolution"),
        F.format_string(DRAFT_BODY, F.col("id"), spans, F.col("source_url")).alias("body"),
        F.lit(FACTS_ONLY).alias("source_license"),
        "source_url",
    )


# Levels of cells that an interval of ranks is cut into: ranks are below 2 ** LEVELS.
LEVELS = 50


def _cells(low: Column, high: Column) -> Column:
    """The cells (level, place) that make up the ranks low <= r < high; a cell is 2 ** level ranks, aligned.

    At most two of a level: the first if its place is odd, the last if the place behind it is.
    """

    def of_level(n: Column) -> Column:
        size = F.pow(F.lit(2.0), n).cast("bigint")
        a, b = F.floor((low + size - 1) / size).cast("bigint"), F.floor(high / size).cast("bigint")
        cell = lambda x: F.struct(n.alias("level"), x.alias("place"))
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("bigint")) == 1
        return F.array(F.when((a < b) & odd(a), cell(a)), F.when((a < b) & odd(b), cell(b - 1)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of_level)), lambda c: c.isNotNull())


def in_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(point, range_id): every range low <= key < high of a group that holds a point of the same group.

    ``points`` is (point, grp, key), ``ranges`` (range_id, grp, low, high), where a null end is open.
    Points and ends of all groups are sorted together by ranges of the sort key, which turns an end into
    the number of points before it.  The ranks between two ends are cut into O(log n) aligned cells
    and points meet ranges by their cells, each pair once: a group with many points and many ranges
    gives its hits and nothing else, and no task holds a whole group.
    """
    kind = points.schema["key"].dataType.simpleString()
    ident = points.schema["point"].dataType.simpleString(), ranges.schema["range_id"].dataType.simpleString()

    def event(df: DataFrame, side: int, key: Column, is_point: bool, point: Column, range_id: Column, end: int) -> DataFrame:
        # An end stands before the points that are equal to it.
        order = F.struct("grp", F.lit(side).alias("side"), key.alias("key"), F.lit(int(is_point)).alias("is_point"))
        return df.select(order.alias("o"), point.alias("point"), range_id.alias("range_id"), F.lit(end).alias("end"))

    none = [F.lit(None).cast(t) for t in (kind, *ident)]
    rid = F.col("range_id")
    low, high = F.col("low"), F.col("high")
    events = (
        event(points, 0, F.col("key"), True, F.col("point"), none[2], 0)
        .union(event(ranges.where(low.isNotNull()), 0, low, False, none[1], rid, 0))
        .union(event(ranges.where(low.isNull()), -1, none[0], False, none[1], rid, 0))
        .union(event(ranges.where(high.isNotNull()), 0, high, False, none[1], rid, 1))
        .union(event(ranges.where(high.isNull()), 1, none[0], False, none[1], rid, 1))
    )
    placed = sorted_places(events, "o")
    is_point = F.col("o.is_point")
    offsets = range_offsets(placed, {"before": F.sum(is_point)})
    upto = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum(is_point).over(upto), F.lit(0)) + F.col("before")
    ranked = cut_lineage(placed.join(F.broadcast(offsets), "_part").select("o.is_point", "point", "range_id", "end", rank.cast("bigint").alias("r")))
    ends = ranked.where("is_point = 0").groupBy("range_id").agg(
        F.max(F.when(F.col("end") == 0, F.col("r"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("r"))).alias("b")
    )
    cells = cut_lineage(ends.where("a < b").select("range_id", F.explode(_cells(F.col("a"), F.col("b"))).alias("cell")).select("range_id", "cell.*"))
    levels = sorted(r.level for r in cells.select("level").distinct().collect())
    own = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("r", n).alias("place")) for n in levels]) if levels else F.array().cast("array<struct<level:int,place:bigint>>")
    at = ranked.where("is_point = 1").select("point", F.explode(own).alias("cell")).select("point", "cell.*")
    return at.join(cells, ["level", "place"]).select("point", "range_id")


def advisory_audit(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies (path, version) inside an affected range of a vulnerability record.

    Versions meet ranges by cells of ranks (:func:`in_ranges`), so a package with many versions and many
    ranges yields its hits only.  Repeated dependencies are looked up once and reported each.
    """
    first_id = F.get(
        F.filter(_strings("symptom.error_signatures"), lambda s: has_prefix(s, AUDIT_PREFIXES)), F.lit(0)
    )
    ranges = cut_lineage(
        advisories.select(F.col("id").alias("record_id"), X.utrim(first_id).alias("advisory_id"), "applies_to")
        .where(F.col("advisory_id").isNotNull())
        .select("record_id", "advisory_id", F.explode("applies_to").alias("a"))
        .where(F.lower("a.ecosystem") == "go")
        .select(
            "record_id",
            "advisory_id",
            F.col("a.package").alias("path"),
            F.nullif(F.col("a.versions.introduced"), F.lit("")).alias("introduced"),
            F.nullif(F.col("a.versions.fixed"), F.lit("")).alias("fixed"),
        )
        .withColumn("range_id", F.monotonically_increasing_id())
    )
    keyed = lambda c: F.when(F.col(c).isNotNull(), V.version_key(c))
    bounds = ranges.where(F.col("path").isNotNull()).select("range_id", F.col("path").alias("grp"), keyed("introduced").alias("low"), keyed("fixed").alias("high"))
    versions = deps.join(ranges.select("path").distinct(), "path", "left_semi").select("path", "version").distinct()
    # A version is parsed once, however many packages have it; the sort by ranges would do so twice for each.
    keys = cut_lineage(deps.select(F.col("version").alias("v")).distinct().withColumn("key", V.version_key("v")))
    points = versions.join(keys, F.col("version").eqNullSafe(F.col("v"))).select(F.struct("path", "version").alias("point"), F.col("path").alias("grp"), "key")
    hits = in_ranges(points, bounds).select("point.path", F.col("point.version").alias("hit"), "range_id")
    found = hits.join(ranges.drop("path"), "range_id")
    same = (deps["path"] == found["path"]) & deps["version"].eqNullSafe(found["hit"])
    return deps.join(found, same).select(
        deps["path"], deps["version"], "record_id", "advisory_id",
        F.coalesce("introduced", F.lit("")).alias("introduced"),
        F.coalesce("fixed", F.lit("")).alias("fixed"),
    )


def staleness(records: DataFrame, cycles: DataFrame, now: str, validated_only: bool = True) -> DataFrame:
    """(id, path, signal, detail): records whose window closed or whose runtime cycle is past its end.

    ``cycles`` is (product, cycle, eol): a date, 'true' (ended, date unknown) or unknown.
    At most one finding per record; the closed window wins, then the first affected entry.
    """
    today = F.lit(now).cast("date")
    if validated_only:
        records = records.where(F.col("status") == "validated")
    until = F.col("provenance.valid.until")
    closed = F.coalesce(X.strict_date(X.utrim(until)) < today, F.lit(False))
    eol = F.nullif(F.lower(X.utrim("eol")), F.lit(""))
    ended = cycles.select(
        "product",
        "cycle",
        F.when(eol == "true", F.lit("0001-01-01")).when(eol != "false", F.col("eol")).alias("ended_on"),
    ).where(X.strict_date("ended_on") < today)
    # The first listed row of a (product, cycle) decides; duplicates carry the same fact.
    ended = ended.groupBy("product", "cycle").agg(F.min("ended_on").alias("ended_on"))
    product = F.create_map(*[F.lit(x) for kv in RUNTIME_PRODUCTS.items() for x in kv])[F.lower("a.ecosystem")]
    pkg = X.utrim(F.coalesce(F.col("a.package"), F.lit("")))
    runtime_pkg = ~F.contains(F.substring_index(pkg, "/", 1), F.lit("."))
    entries = (
        records.select("id", "path", closed.alias("closed"), until.alias("until"), F.posexplode_outer("applies_to").alias("pos", "a"))
        .withColumn("product", F.when(runtime_pkg & ~F.col("closed"), product))
        .withColumn("cycle", V.major_minor("a.versions.fixed"))
    )
    joined = entries.join(ended, ["product", "cycle"], "left")
    window = F.when(F.col("closed") , F.struct(F.lit(-1).alias("pos"), F.lit("window_closed").alias("signal"), F.col("until").alias("detail")))
    runtime = F.when(
        F.col("ended_on").isNotNull(),
        F.struct(
            F.coalesce("pos", F.lit(0)).alias("pos"),
            F.lit("runtime_ended").alias("signal"),
            F.concat_ws(" ", "product", "cycle", "ended_on").alias("detail"),
        ),
    )
    return (
        joined.withColumn("f", F.coalesce(window, runtime))
        .where(F.col("f").isNotNull())
        .groupBy("id", "path")
        .agg(F.min("f").alias("f"))
        .select("id", "path", "f.signal", "f.detail")
    )
