"""Model replies assembled into batches, matchings and drafts, or refused with a code.

A reply is read by the declarations of its own profile, which come as rows: replies of profiles of any shape are assembled in one
pass, without a schema for each. All of a reply is worked out within its row (VARIANT and higher-order functions);
the only shuffle is the join with the profiles' declarations. A value that fails its normal form is not an error: it
becomes invalid, and its list partial or unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from extractlab.functions import scalar as fn
from extractlab.functions.shapes import Each, Object, OneOf, Text, Union, Whole, bound, entries, is_, items, kind, text
from extractlab.functions.strict import strict_problem
from extractlab.operators import contracts, rules

#: Statuses of values and lists, reasons, and what pages can say of their document.
STATUSES = ("extracted", "missing", "unreadable", "ambiguous", "invalid")
LIST_STATUSES = ("complete", "partial", "unresolved")
REASONS = ("missing", "unreadable", "ambiguous", "invalid")
MEMBERSHIPS = ("yes", "no", "unclear")
MATCHING = ("matched", "no_profile", "uncertain", "unreadable", "mixed", "not_document")
SCALAR_TYPES = ("text", "date", "number", "boolean")
#: Why a reply is refused; of several the first in this order counts. Before them come those of the text itself.
CODES = (
    "wire_object_keys", "wire_pages_type", "wire_rows_type", "wire_value_type", "pages_invalid", "raw_required", "raw_forbidden", "pages_required", "cell_pages_outside_row",
    "complete_needs_enumeration_and_cells", "partial_needs_accepted_cell", "unresolved_has_accepted_cell", "unresolved_needs_reason", "reason_forbidden", "partial_is_complete",
    "pages_unavailable", "boundary_flags",
)


def code(name: str) -> Column:
    return F.lit(CODES.index(name))


def first(*checks: tuple[str, Column]) -> Column:
    """The number of the first check that holds, null if none does."""
    found = F.lit(None).cast("int")
    for name, holds in sorted(checks, key=lambda c: -CODES.index(c[0])):
        found = F.when(is_(holds), code(name)).otherwise(found)
    return found


def least(values: Column) -> Column:
    """The smallest of an array of numbers, nulls apart."""
    return F.array_min(F.array_compact(values))


def date_forms(formats: Column) -> Column:
    """Formats of dates that come as data, ISO among them, ready to be read by: the pattern of a whole text (``whole``) and, of formats with a day, a month and a
    year each, a date's groups in it (``plain``); else Spark's own spelling (``spelled``). Their literal parts hold no letters."""

    def ready(form: Column) -> Column:
        quoted = F.regexp_replace(form, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
        plain = F.sort_array(F.regexp_extract_all(form, F.lit("%[Ymd]"), F.lit(0))) == F.array(F.lit("%Y"), F.lit("%d"), F.lit("%m"))

        def put(text: Column, *parts: str) -> Column:
            for name, part in zip(("%Y", "%d", "%m"), parts, strict=True):
                text = F.replace(text, F.lit(name), F.lit(part))
            return text

        named, bare = put(quoted, "(?<y>[0-9]{4})", "(?<d>0?[1-9]|[12][0-9]|3[01])", "(?<m>0?[1-9]|1[0-2])"), put(quoted, "[0-9]{4}", "[0-9]{1,2}", "[0-9]{1,2}")
        return F.struct(F.concat(F.lit(r"\A"), F.when(plain, named).otherwise(bare), F.lit(r"\z")).alias("whole"), put(form, "yyyy", "d", "M").alias("spelled"), plain.alias("plain"))

    return F.transform(F.array_distinct(F.concat(F.array(F.lit("%Y-%m-%d")), formats)), ready)


def date_readings(raw: Column, forms: Column) -> Column:
    """The different ISO dates that a text can mean in :func:`date_forms`."""

    def read(form: Column) -> Column:
        # A cast costs less than a formatter, whose exceptions for texts that are no date are dear; so are a cast's, which only days beyond a month's end get.
        date = F.regexp_replace(raw, form["whole"], F.lit("${y}-${m}-${d}")).try_cast("date").cast("string")
        fits = F.regexp_like(raw, form["whole"])
        return F.when(fits, F.when(form["plain"], date).otherwise(F.date_format(F.try_to_timestamp(raw, form["spelled"]), "yyyy-MM-dd")))

    return F.array_distinct(F.array_compact(F.transform(forms, read)))


def _pages(values: Column) -> Column:
    """An array of whole numbers as such; null if any is none."""
    whole = F.transform(values, lambda x: F.when(kind(x) == "BIGINT", F.try_variant_get(x, "$", "bigint")))
    return bound(whole, lambda own: F.when(~F.exists(own, lambda x: x.isNull()), own))


def _twice(pages: Column) -> Column:
    return (F.size(pages) > 1) & ~rules.unique(pages)


def _beyond(pages: Column, within: Column) -> Column:
    """Whether a page is not among others."""
    return F.exists(pages, lambda p: ~F.array_contains(within, p))


#: Of cells whose parts all have their types, what they are by the type of ``v``.
TYPED = {f"OBJECT<p: ARRAY<{pages}>, s: STRING, v: {value}>": value for pages in ("BIGINT", "VOID") for value in ("STRING", "BOOLEAN", "VOID")}


def _told(cells: Column) -> Column:
    """Cells (declaration ``d``, value ``c``, its type ``of``) with their parts by type. A cell of the right types is read at once, another part by part."""

    def all_numbers(pages: Column) -> Column:
        return F.when(~F.exists(pages, lambda p: p.isNull()), pages)

    def typed(z: Column) -> Column:
        read = F.try_variant_get(z["c"], "$", "struct<s: string, v: string, p: array<bigint>>")
        value = F.when(z["of"].endswith("v: STRING>"), "STRING").when(z["of"].endswith("v: BOOLEAN>"), "BOOLEAN").otherwise("VOID")
        return bound(read, lambda c: F.struct(z["d"].alias("d"), F.lit(True).alias("keys"), c["s"].alias("status"), value.alias("kind"), c["v"].alias("raw"), F.lit(True).alias("listed"), all_numbers(c["p"]).alias("pages")))

    def part_by_part(z: Column) -> Column:
        at = lambda m, name: F.try_element_at(m, F.lit(name))
        return bound(entries(z["c"]), lambda m: F.struct(
            z["d"].alias("d"), ((F.size(m) == 3) & at(m, "s").isNotNull() & at(m, "v").isNotNull() & at(m, "p").isNotNull()).alias("keys"), text(at(m, "s")).alias("status"),
            kind(at(m, "v")).alias("kind"), F.try_variant_get(at(m, "v"), "$", "string").alias("raw"), items(at(m, "p")).isNotNull().alias("listed"), _pages(items(at(m, "p"))).alias("pages"),
        ))

    return F.transform(cells, lambda z: F.when(z["of"].isin(*TYPED), typed(z)).otherwise(part_by_part(z)))


def _normal(c: Column) -> Column:
    """A value's normal form by its declared type; null if it has none."""
    said = c["kind"] == "STRING"
    date = bound(date_readings(c["raw"], c["d"]["forms"]), lambda read: F.when(F.size(read) == 1, F.get(read, F.lit(0))).when(F.size(read) == 0, c["raw"]))
    declared = c["d"]["kind"]
    return (
        F.when(declared == "boolean", F.when(c["kind"] == "BOOLEAN", c["raw"])).when(~is_(said), F.lit(None))
        .when(declared == "number", fn.normal_number(c["raw"])).when(declared == "date", date).otherwise(c["raw"])
    )


def _settled(cells: Column, in_list: bool) -> Column:
    """Cells as results: what fails its normal form is invalid; ``problem`` is the first code, ``original`` the reply's status."""
    formed = F.transform(cells, lambda c: F.struct(c.alias("c"), _normal(c).alias("normal")))

    def settle(z: Column) -> Column:
        c, taken = z["c"], z["c"]["status"] == "extracted"
        status = F.when(taken & z["normal"].isNull(), "invalid").otherwise(c["status"])
        kept = F.when(is_(taken & ((c["d"]["kind"] == "number") | (z["normal"] != c["raw"]))), z["normal"])
        raw = F.when(c["kind"] != "VOID", c["raw"])
        judged = c["status"] if in_list else status
        problem = first(
            ("wire_object_keys", ~is_(c["keys"])), ("wire_pages_type", ~c["listed"]),
            ("wire_value_type", ~is_(c["status"].isin(*STATUSES)) | ~is_(c["kind"].isin("STRING", "BOOLEAN", "VOID")) | (c["listed"] & c["pages"].isNull())),
            ("pages_invalid", _twice(c["pages"]) | F.exists(c["pages"], lambda p: p < 1)),
            ("raw_required", F.lit(in_list) & (c["status"] == "extracted") & raw.isNull()), ("raw_forbidden", ~judged.isin("extracted", "invalid") & raw.isNotNull()),
            ("pages_required", raw.isNotNull() & (F.size(c["pages"]) == 0)),
        )
        return F.struct(c["d"]["id"].alias("field_id"), status.alias("status"), raw.alias("raw"), kept.alias("normalized"), c["pages"].alias("pages"), c["status"].alias("original"), problem.alias("problem"))

    return F.transform(formed, settle)


def _cells(declared: Column, found: Column) -> Column:
    own = F.transform(declared, lambda d: F.struct(d.alias("d"), F.try_element_at(found, d["id"]).alias("c")))
    return F.transform(own, lambda z: F.struct(z["d"].alias("d"), z["c"].alias("c"), kind(z["c"]).alias("of")))


def _same_names(found: Column, wanted: Column) -> Column:
    return is_(F.sort_array(F.map_keys(found)) == F.sort_array(wanted))


def _rows(declared: Column, listed: Column, first_page: Column) -> Column:
    """Rows of a list as results, with their first problem."""
    maps = F.transform(listed, lambda x, i: F.struct(entries(x).alias("m"), i.alias("i")))
    told = F.transform(
        maps,
        lambda z: F.struct(
            z["i"].alias("i"), z["m"].alias("m"), entries(F.try_element_at(z["m"], F.lit("cells"))).alias("cells"),
            items(F.try_element_at(z["m"], F.lit("pages"))).alias("listed"),
            F.try_variant_get(F.try_element_at(z["m"], F.lit("continues_previous")), "$", "boolean").alias("before"), kind(F.try_element_at(z["m"], F.lit("continues_previous"))).alias("before_kind"),
            F.try_variant_get(F.try_element_at(z["m"], F.lit("continues_next")), "$", "boolean").alias("after"), kind(F.try_element_at(z["m"], F.lit("continues_next"))).alias("after_kind"),
        ),
    )
    read = F.transform(told, lambda z: F.struct(z.alias("z"), _settled(_told(_cells(declared, z["cells"])), True).alias("cells"), _pages(z["listed"]).alias("pages")))
    last = F.size(listed) - 1

    def settle(r: Column) -> Column:
        z, pages = r["z"], r["pages"]
        names = F.array(*(F.lit(n) for n in ("cells", "continues_next", "continues_previous", "pages")))
        problem = least(F.concat(F.array(first(
            ("wire_object_keys", ~is_(F.sort_array(F.map_keys(z["m"])) == names) | ~_same_names(z["cells"], F.transform(declared, lambda d: d["id"]))),
            ("wire_pages_type", z["listed"].isNull()),
            ("wire_value_type", (z["listed"].isNotNull() & pages.isNull()) | ~is_((z["before_kind"] == "BOOLEAN") & (z["after_kind"] == "BOOLEAN"))),
            ("pages_invalid", _twice(pages) | F.exists(pages, lambda p: p < 1)), ("pages_required", F.size(pages) == 0),
            ("cell_pages_outside_row", F.exists(r["cells"], lambda c: _beyond(c["pages"], pages))),
            ("boundary_flags", (z["before"] & (z["i"] != 0)) | (z["after"] & (z["i"] != last))),
        )), F.transform(r["cells"], lambda c: c["problem"])))
        key = F.concat(F.lit("batch:"), first_page.cast("string"), F.lit(":row:"), z["i"].cast("string"))
        return F.struct(r["cells"].alias("cells"), pages.alias("pages"), key.alias("source_key"), z["before"].alias("continues_previous"), z["after"].alias("continues_next"), problem.alias("problem"))

    return F.transform(read, settle)


def _list_problem(status: Column, whole: Column, reason: Column, of: Column, by: str) -> Column:
    """The first rule of lists that is broken, of what was said of all cells' statuses under one name."""
    return first(*contracts.list_rules(status, whole, reason, of[f"{by}_accepted"], of[f"{by}_resolved"]).items())


def _lists(declared: Column, found: Column, first_page: Column, pages: Column) -> Column:
    """Lists as results, with their first problem."""
    maps = F.transform(declared, lambda d: F.struct(d.alias("d"), entries(F.try_element_at(found, d["id"])).alias("m")))
    told = F.transform(
        maps,
        lambda z: F.struct(
            z["d"].alias("d"), z["m"].alias("m"), text(F.try_element_at(z["m"], F.lit("status"))).alias("status"),
            F.try_variant_get(F.try_element_at(z["m"], F.lit("enumeration_complete")), "$", "boolean").alias("whole"), kind(F.try_element_at(z["m"], F.lit("enumeration_complete"))).alias("whole_kind"),
            text(F.try_element_at(z["m"], F.lit("reason"))).alias("reason"), kind(F.try_element_at(z["m"], F.lit("reason"))).alias("reason_kind"), items(F.try_element_at(z["m"], F.lit("rows"))).alias("listed"),
        ),
    )
    read = F.transform(told, lambda z: F.struct(z.alias("z"), _rows(z["d"]["columns"], z["listed"], first_page).alias("rows")))
    flat = F.transform(read, lambda r: F.struct(r["z"].alias("z"), r["rows"].alias("rows"), F.flatten(F.transform(r["rows"], lambda w: w["cells"])).alias("cells")))
    some = lambda cells, test: is_(F.exists(cells, test))
    settled = ("extracted", "missing")

    def judged(cells: Column, by: str) -> list[Column]:
        return [some(cells, lambda c: c[by] == "extracted").alias(f"{by}_accepted"), is_(F.forall(cells, lambda c: c[by].isin(*settled))).alias(f"{by}_resolved")]

    weighed = F.transform(
        flat,
        lambda r: F.struct(
            r["z"].alias("z"), r["rows"].alias("rows"),
            some(r["cells"], lambda c: (c["status"] != c["original"]) | c["normalized"].isNotNull()).alias("changed"), some(r["cells"], lambda c: ~c["status"].isin(*settled)).alias("open"),
            *judged(r["cells"], "original"), *judged(r["cells"], "status"),
        ),
    )

    def judge(r: Column) -> Column:
        # An unresolved cell that the reply had taken for granted makes the list partial, or unresolved as invalid.
        turned, accepted = r["changed"] & r["open"], r["status_accepted"]
        status = F.when(turned, F.when(accepted, "partial").otherwise("unresolved")).otherwise(r["z"]["status"])
        reason = F.when(turned, F.when(~accepted, "invalid")).otherwise(r["z"]["reason"])
        return F.struct(r.alias("r"), status.alias("status"), reason.alias("reason"))

    def settle(x: Column) -> Column:
        r, z = x["r"], x["r"]["z"]
        names = F.array(*(F.lit(n) for n in ("enumeration_complete", "reason", "rows", "status")))
        problem = least(F.concat(F.array(
            first(
                ("wire_object_keys", ~is_(F.sort_array(F.map_keys(z["m"])) == names)), ("wire_rows_type", z["listed"].isNull()),
                ("wire_value_type", ~is_(z["status"].isin(*LIST_STATUSES)) | ~is_(z["whole_kind"] == "BOOLEAN") | ~is_((z["reason_kind"] == "VOID") | z["reason"].isin(*REASONS))),
                ("pages_unavailable", F.exists(r["rows"], lambda w: _beyond(w["pages"], pages))),
            ),
            _list_problem(z["status"], z["whole"], z["reason"], r, "original"), _list_problem(x["status"], z["whole"], x["reason"], r, "status"),
        ), F.coalesce(F.transform(r["rows"], lambda w: w["problem"]), F.array().cast("array<int>"))))
        return F.struct(z["d"]["id"].alias("field_id"), x["status"].alias("status"), x["reason"].alias("reason"), z["whole"].alias("enumeration_complete"), r["rows"].alias("rows"), problem.alias("problem"))

    return F.transform(F.transform(weighed, judge), settle)


def profile_shapes(declarations: DataFrame) -> DataFrame:
    """(profile, scalars, lists) of declarations (profile, list_id or null, field_id, kind, formats, place): a profile's fields in one row."""
    one = F.struct("place", F.col("field_id").alias("id"), "kind", F.coalesce("formats", F.array().cast("array<string>")).alias("formats"))
    bare = lambda c: F.transform(F.array_sort(c), lambda d: F.struct(d["id"].alias("id"), d["kind"].alias("kind"), date_forms(d["formats"]).alias("forms")))
    parts = declarations.groupBy("profile", "list_id").agg(bare(F.collect_list(one)).alias("columns"), F.min("place").alias("place"))  # a declaration's few rows
    lists = F.array_sort(F.collect_list(F.when(F.col("list_id").isNotNull(), F.struct("place", F.col("list_id").alias("id"), "columns"))))
    scalars = F.coalesce(F.max(F.when(F.col("list_id").isNull(), F.col("columns"))), F.array().cast("array<struct<id:string,kind:string,forms:array<struct<whole:string,spelled:string,plain:boolean>>>>"))
    return parts.groupBy("profile").agg(scalars.alias("scalars"), F.transform(lists, lambda x: F.struct(x["id"].alias("id"), x["columns"].alias("columns"))).alias("lists"))


def parsed_batches(replies: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """key, problem (null if the reply is accepted), fields, lists and membership of each reply (key, profile, pages, text).

    Refused replies give no results. A null text is ``no_text``; replies whose profile isn't there are left out."""
    j = F.col
    rows = replies.join(shapes, "profile").withColumns({"_strict": strict_problem(j("text")), "_root": entries(F.try_parse_json("text"))})
    part = lambda name: entries(F.try_element_at(j("_root"), F.lit(name)))
    rows = rows.withColumns({"_fields": part("fields"), "_lists": part("lists"), "_pages": part("membership"), "_own": j("pages").cast("array<bigint>")})
    rows = rows.withColumns({
        "_values": _settled(_told(_cells(j("scalars"), j("_fields"))), False),
        "_found": _lists(j("lists"), j("_lists"), F.get("pages", F.lit(0)), j("_own")),
        "_told": F.transform("pages", lambda p: F.struct(p.alias("page"), text(F.try_element_at(j("_pages"), p.cast("string"))).alias("status"))),
    })
    names = F.array(F.lit("fields"), F.lit("lists"), F.lit("membership"))
    ids = lambda declared: F.transform(declared, lambda d: d["id"])
    keys = (
        is_(F.sort_array(F.map_keys("_root")) == names) & _same_names(j("_fields"), ids(j("scalars"))) & _same_names(j("_lists"), ids(j("lists")))
        & _same_names(j("_pages"), F.transform("pages", lambda p: p.cast("string")))
    )
    own = first(
        ("wire_object_keys", ~keys), ("wire_value_type", F.exists("_told", lambda t: ~is_(t["status"].isin(*MEMBERSHIPS)))),
        ("pages_unavailable", F.exists("_values", lambda c: _beyond(c["pages"], j("_own")))),
    )
    worst = least(F.concat(F.array(own), F.transform("_values", lambda c: c["problem"]), F.transform("_found", lambda x: x["problem"])))
    problem = F.coalesce("_strict", F.get(F.array(*(F.lit(c) for c in CODES)), worst))
    result = lambda c: F.struct(*(c[n].alias(n) for n in ("field_id", "status", "raw", "normalized", "pages")))
    row = lambda w: F.struct(F.transform(w["cells"], result).alias("cells"), *(w[n].alias(n) for n in ("pages", "source_key", "continues_previous", "continues_next")))
    listed = lambda x: F.struct(*(x[n].alias(n) for n in ("field_id", "status", "reason", "enumeration_complete")), F.transform(x["rows"], row).alias("rows"))
    fine = j("problem").isNull()
    return rows.withColumn("problem", problem).select(
        key, "problem", F.when(fine, F.transform("_values", result)).alias("fields"), F.when(fine, F.transform("_found", listed)).alias("lists"), F.when(fine, j("_told")).alias("membership")
    )


def parsed_matching(replies: DataFrame, key: str) -> DataFrame:
    """key, problem, status, profile of each reply (key, text, ``snapshots``: the profiles that the call was given, in order)."""
    v = F.try_parse_json("text")
    m = entries(v)
    status, index = text(F.try_element_at(m, F.lit("status"))), F.try_element_at(m, F.lit("profile_index"))
    described = F.try_element_at(m, F.lit("type_description"))
    number = F.when(kind(index) == "BIGINT", F.try_variant_get(index, "$", "bigint"))
    given = index.isNotNull() & ~is_(F.is_variant_null(index))
    typed = Object({"status": OneOf(MATCHING), "profile_index": Whole(-(1 << 62), null=True), "type_description": Text(null=True)}, ("profile_index", "type_description"))
    problem = (
        F.when(strict_problem(F.col("text")).isNotNull(), strict_problem(F.col("text")))
        .when(~is_(F.size(F.array_except(F.map_keys(m), F.array(*(F.lit(n) for n in typed.names)))) == 0) | ~is_(F.array_contains(F.map_keys(m), "status")), "wire_object_keys")
        .when(~typed.fits(v), "wire_value_type").when((status == "matched") & ~is_(number >= 1), "profile_index_required").when((status != "matched") & given, "profile_index_forbidden")
        .when((status == "no_profile") & ~Text(1, visible=True).fits(described), "type_description_required")
        .when((status == "matched") & (number > F.size("snapshots")), "profile_index_outside_snapshots")
    )
    rows = replies.select(key, problem.alias("problem"), status.alias("_status"), number.alias("_number"), "snapshots")
    fine = F.col("problem").isNull()
    return rows.select(key, "problem", F.when(fine, F.col("_status")).alias("status"), F.when(fine, F.get("snapshots", (F.col("_number") - 1).cast("int"))).alias("profile"))


def _validator_fits(own: Column) -> Column:
    """The rules of a declared format check, of its map."""
    listed = lambda name: F.coalesce(F.transform(items(F.try_element_at(own, F.lit(name))), text), F.array().cast("array<string>"))
    broken = rules.validator_rules(text(F.try_element_at(own, F.lit("kind"))), listed("date_formats"), listed("allowlist"))
    return ~F.array_contains(F.array(*(is_(b) for b in broken.values())), True)


_VALIDATOR = Object(
    {"kind": OneOf(("calendar_date", "iban", "luhn", "iso_code")), "date_formats": Each(Text()), "allowlist": Each(Text())}, ("date_formats", "allowlist"), _validator_fits, null=True
)
_SCALAR = Object(
    {"type": OneOf(SCALAR_TYPES), "id": Text(1), "label": Text(1), "description": Text(1), "validator": _VALIDATOR, "validator_basis": Text()}, ("validator", "validator_basis")
)
_LIST = Object({"type": OneOf(("list",)), "id": Text(1), "label": Text(1), "description": Text(1), "columns": Each(_SCALAR, 1)})
_DRAFT = Object(
    {"name": Text(1), "description": Text(1), "scalar_fields": Each(_SCALAR), "lists": Each(_LIST), "guidance": Text(), "source_index": Whole(1, null=True)}, ("guidance",),
    lambda own: F.size(items(F.try_element_at(own, F.lit("scalar_fields")))) + F.size(items(F.try_element_at(own, F.lit("lists")))) > 0,
)
#: Drafts, or questions, never both.
DRAFT_REPLY = Union("status", {
    "drafts": Object({"status": Text(), "drafts": Each(_DRAFT, 1), "questions": Each(Text(), 0, 0)}),
    "questions": Object({"status": Text(), "drafts": Each(_DRAFT, 0, 0), "questions": Each(Text(visible=True), 1)}),
})


def draft_replies(replies: DataFrame, key: str) -> DataFrame:
    """key, status, and of accepted replies the drafts (name, source_index, scalars, lists) or questions; refused ones have the status ``refused``."""
    v = F.try_parse_json("text")
    m = entries(v)
    fine = strict_problem(F.col("text")).isNull() & DRAFT_REPLY.fits(v)

    def draft(x: Column) -> Column:
        own = entries(x)
        at = lambda name: F.try_element_at(own, F.lit(name))
        return F.struct(
            text(at("name")).alias("name"), F.try_variant_get(at("source_index"), "$", "bigint").alias("source_index"), F.size(items(at("scalar_fields"))).alias("scalars"), F.size(items(at("lists"))).alias("lists")
        )

    part = lambda name: items(F.try_element_at(m, F.lit(name)))
    return replies.select(
        key, F.when(fine, text(F.try_element_at(m, F.lit("status")))).otherwise("refused").alias("status"),
        F.when(fine, F.transform(part("drafts"), draft)).alias("drafts"), F.when(fine, F.transform(part("questions"), text)).alias("questions"),
    )
