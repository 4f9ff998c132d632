"""Content differences of two versions of a typed document, as notes in a fixed order.

Texts are read lower-cased. Every function takes the two texts as columns and gives an array of
notes; nothing leaves the row, so a pair costs its own two texts and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.graph import checkpoint

from docweave.operators.revisions import ITEM, revision_changes

Texts = tuple[Column, Column]
BRACKETED = r"\[.*?\]"


def first(texts: Texts, pattern: str, group: int = 1) -> Texts:
    """The group of the first match in each text; null without one."""
    return tuple(F.nullif(F.regexp_extract(t, pattern, group), F.lit("")) for t in texts)


def numbers(found: Texts) -> Texts:
    return tuple(F.replace(x, F.lit(","), F.lit("")).try_cast("double") for x in found)


def moved(found: Texts, template: str, *more: Column, digits: int | None = None) -> Column:
    """A note where both texts have the value and it differs; with digits, the values are shown as amounts."""
    old, new = found
    shown = (old, new) if digits is None else (amount(old, digits), amount(new, digits))
    return F.when(old != new, F.format_string(template, *shown, *more))


def amount(x: Column, digits: int = 0) -> Column:
    """A number with commas and that many decimals; halves of its exact value go to the even digit, as in Python and C."""
    return F.format_number(x, digits)


def signed_percent(x: Column) -> Column:
    """+1.5 or -1.5, rounded as amount(); format_string would round the shortest decimal form up at a half."""
    return F.concat(F.when(x >= 0, "+").otherwise(""), F.replace(amount(x, 1), F.lit(","), F.lit("")))


def status(texts: Texts) -> Column:
    return moved(tuple(F.upper(x) for x in first(texts, r"status[:\s]+(\w+)")), "Status changed: %s → %s")


def percent(found: Texts) -> Column:
    old, new = found
    return (new - old) / old * 100


def total(texts: Texts, pattern: str, template: str, digits: int = 0) -> Column:
    found = numbers(first(texts, pattern))
    return F.when(found[0] != 0, moved(found, template, signed_percent(percent(found)), digits=digits))


def entries(text: Column, pattern: str, *names: str) -> Column:
    """All matches as structs; the names are those of the pattern's groups, the first the key."""
    groups = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(len(names))])
    return F.transform(groups, lambda m: F.struct(*[F.trim(m[str(i)]).alias(n) for i, n in enumerate(names)]))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out one time, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def by_key(texts: Texts, pattern: str, names: tuple[str, ...], notes: Callable, ordered: bool = True) -> Column:
    """Notes for every key of either text: a full outer join of the two lists inside the row.

    notes(key, old, new) gets the last entry of the key on each side, null where there is none. Keys
    come sorted, or as the new text has them.
    """
    key = names[0]
    keys = lambda rows: F.transform(rows, lambda r: r[key])
    last = lambda rows, k: F.try_element_at(F.filter(rows, lambda r: r[key] == k), F.lit(-1))

    def joined(e: Column) -> Column:
        all_keys = F.array_sort(F.array_distinct(F.concat(keys(e["old"]), keys(e["new"])))) if ordered else F.array_distinct(keys(e["new"]))
        sides = lambda k: F.struct(last(e["old"], k).alias("old"), last(e["new"], k).alias("new"))
        return F.flatten(F.transform(all_keys, lambda k: once(sides(k), lambda m: F.array(*notes(k, m["old"], m["new"])))))

    return once(F.struct(*[entries(t, pattern, *names).alias(n) for t, n in zip(texts, ("old", "new"))]), joined)


def both(old: Column, new: Column) -> Column:
    return old.isNotNull() & new.isNotNull()


def as_number(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit("")).try_cast("double")


def unmarked(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BRACKETED, ""))


def purchase_order(texts: Texts) -> Column:
    """Numbered items (quantity, price, new ones), rush fee, timeline, lists without numbers, total, delivery date."""
    prev, curr = texts
    price = lambda e: F.when(as_number(e["price"]) != 0, as_number(e["price"]))

    def item(number, old, new):
        added = old.isNull() & new.isNotNull()
        return (
            F.when(both(old, new) & (old["quantity"] != new["quantity"]), F.format_string("Quantity increase: %s (%s → %s units)", old["name"], old["quantity"], new["quantity"])),
            F.when(both(old, new) & (price(old) != price(new)), F.format_string("Price adjustment: %s ($%s → $%s)", old["name"], amount(price(old), 2), amount(price(new), 2))),
            F.when(added & price(new).isNotNull(), F.format_string("New item added: %s (Quantity: %s units, Price: $%s)", new["name"], new["quantity"], amount(price(new), 2))),
            F.when(added & price(new).isNull(), F.format_string("New item added: %s (Quantity: %s units)", new["name"], new["quantity"])),
        )

    items = F.array_compact(by_key(texts, ITEM, ("number", "name", "quantity", "price"), item))
    fee = F.coalesce(*[as_number(first((curr, curr), p)[0]) for p in (r"rush[^\n]*?(?:unit\s*price|price)\s*[:\-]?\s*\$?([\d,]+(?:\.\d+)?)", r"rush[^\n]*?\$([\d,]+(?:\.\d+)?)")])
    rush = F.when(
        curr.contains("rush") & ~prev.contains("rush") & ~F.lower(F.array_join(items, "\n")).contains("rush delivery fee"),
        F.when(fee.isNotNull(), F.format_string("Rush delivery fee added: $%s", amount(fee, 2))).otherwise("Rush delivery fee added"),
    )
    days = tuple(x.cast("int") for x in first(texts, r"(?:timeline|delivery|duration)[:\s]+(\d+)\s*(?:days?|weeks?)"))
    shorter = F.when(days[1] < days[0], F.format_string("Timeline compressed: %d days → %d days", *days))

    def listed(pattern: str, template: str) -> Column:
        old, new = (F.regexp_extract_all(t, F.lit(pattern), F.lit(1)) for t in texts)
        pairs = F.transform(F.arrays_zip(old, new), lambda m, i: F.when(m["0"] != m["1"], F.format_string(template, F.when(i < 2, F.concat(F.lit("Item "), (i + 1).cast("string"))).otherwise("Additional items"), m["0"], m["1"])))
        return F.when((F.size(old) == F.size(new)) & unnumbered, pairs).otherwise(F.array().cast("array<string>"))

    unnumbered = ~prev.rlike(ITEM) & ~curr.rlike(ITEM)
    plain = F.concat(listed(r"quantity[:\s]+(\d+)", "Quantity change: %s (%s → %s units)"), listed(r"unit\s*price[:\s]+\$?(\d+(?:\.\d+)?)", "Price adjustment: %s ($%s → $%s)"))
    last = F.array(
        total(texts, r"total[:\s]+\$?(\d+(?:,\d+)?(?:\.\d+)?)", "Total cost change: $%s → $%s (%s%%)", 2),
        moved(first(texts, r"delivery\s*date[:\s]+(\d{4}-\d{2}-\d{2})"), "Delivery date changed: %s → %s"),
    )
    return F.concat(items, F.array(rush, shorter), plain, last)


def prescription(texts: Texts) -> Column:
    """Medications by number (dose, quantity, new ones), refills, reason."""
    curr = texts[1]

    def medication(number, old, new):
        dose, dose_now = (F.nullif(F.regexp_extract(e["name"], r"(\d+)\s*mg", 1), F.lit("")).cast("int") for e in (old, new))
        way = F.when(dose_now > dose, "increased").when(dose_now < dose, "decreased")
        return (
            F.when(both(old, new) & way.isNotNull(), F.format_string("Dosage %s: %s (%dmg → %dmg)", way, old["name"], dose, dose_now)),
            F.when(both(old, new) & (old["quantity"] != new["quantity"]), F.format_string("Quantity change: %s (%s → %s tablets)", old["name"], old["quantity"], new["quantity"])),
            F.when(old.isNull() & new.isNotNull(), F.format_string("New medication added: %s (Quantity: %s tablets)", new["name"], new["quantity"])),
        )

    reason = F.trim(first((curr, curr), r"reason[:\s]+([^\n]+)")[0])
    told = curr.contains("[changed:") | curr.contains("[new medication]")
    return F.concat(
        by_key(texts, r"(\d+)\.\s*([^-]+?)\s*-\s*quantity[:\s]+(\d+)", ("number", "name", "quantity"), medication),
        F.array(moved(first(texts, r"refills?[:\s]+(\d+)"), "Refills changed: %s → %s"), F.when(told & reason.isNotNull(), F.concat(F.lit("Reason for change: "), reason))),
    )


def risen(texts: Texts, pattern: str, template: str, digits: int = 0) -> Column:
    """A note of a changed amount with the difference."""
    found = numbers(first(texts, pattern))
    return moved(found, template, amount(found[1] - found[0], digits), digits=digits)


def offer_letter(texts: Texts) -> Column:
    """Salary, signing bonus, stock options, remote work, status."""
    prev, curr = texts
    remote = F.trim(first((curr, curr), r"remote\s*work[:\s]+([^\n]+)")[0])
    options = numbers(first(texts, r"stock\s*options?[:\s]+(\d+)"))
    return F.array(
        risen(texts, r"(?:base\s*)?salary[:\s]+\$?([\d,]+)", "Base salary changed: $%s → $%s (+$%s)"),
        risen(texts, r"signing\s*bonus[:\s]+\$?([\d,]+)", "Signing bonus changed: $%s → $%s (+$%s)"),
        moved(options, "Stock options changed: %.0f → %.0f shares (+%.0f)", options[1] - options[0]),
        F.when(curr.contains("remote work") & ~prev.contains("remote work") & remote.isNotNull(), F.format_string("New benefit added: Remote Work (%s)", remote)),
        status(texts),
    )


def proposal(texts: Texts) -> Column:
    """Numbered scope lines, price lines, total, timeline, payment terms."""

    def scope(key, old, new):
        was, now = unmarked(old["value"]), unmarked(new["value"])
        return (
            F.when(old.isNull(), F.format_string("New scope item added: %s (%s)", F.initcap(key), now)),
            F.when(old.isNotNull() & (was != now), F.format_string("Scope updated: %s (%s → %s)", F.initcap(key), was, now)),
        )

    def cost(key, old, new):
        was, now = as_number(old["price"]), as_number(new["price"])
        sign = F.when(now >= was, "+").otherwise("-")
        return (
            F.when(old.isNull() & now.isNotNull(), F.format_string("New cost item added: %s ($%s)", F.initcap(key), amount(now))),
            F.when(was != now, F.format_string("Cost updated: %s ($%s → $%s, %s$%s)", F.initcap(key), amount(was), amount(now), sign, amount(F.abs(now - was)))),
        )

    days = tuple(x.cast("int") for x in first(texts, r"timeline[:\s]+(\d+)\s*(?:days?|weeks?)"))
    longer = F.when(days[1] > days[0], F.format_string("Timeline extended: %d → %d days (+%d days)", *days, days[1] - days[0]))
    shorter = F.when(days[1] < days[0], F.format_string("Timeline compressed: %d → %d days (-%d days)", *days, days[0] - days[1]))
    terms = tuple(F.trim(x) for x in first(texts, r"payment\s*terms[:\s]+([^\n]+)"))
    return F.concat(
        by_key(texts, r"(?m)^\s*\d+\.\s*([^:]+):\s*([^\n]+)$", ("key", "value"), scope, ordered=False),
        by_key(texts, r"(?m)^\s*-\s*([^:]+):\s*\$?([\d,]+(?:\.\d+)?)", ("key", "price"), cost),
        F.array(total(texts, r"total[:\s]+\$?([\d,]+(?:\.\d+)?)", "Total value changed: $%s → $%s (%s%%)"), F.coalesce(longer, shorter), moved(terms, "Payment terms changed: %s → %s")),
    )


def expense_report(texts: Texts) -> Column:
    """Subtotal, expenses that are new and marked as added or missing, status."""

    def expense(name, old, new):
        flagged = name.contains("[added") | name.contains("missing")
        return (F.when(old.isNull() & flagged, F.format_string("New expense added: %s ($%s)", unmarked(name), amount(as_number(new["amount"]), 2))),)

    return F.concat(
        F.array(risen(texts, r"subtotal[:\s]+\$?([\d,]+\.?\d*)", "Subtotal changed: $%s → $%s (+$%s)", 2)),
        by_key(texts, r"\d+\.\s*([^-]+?)\s*-\s*\$?([\d,]+\.?\d*)", ("name", "amount"), expense),
        F.array(status(texts)),
    )


def contract(texts: Texts) -> Column:
    """Service period, monthly fee, total value, a new provision."""
    curr = texts[1]
    months = tuple(x.cast("int") for x in first(texts, r"service\s*period[:\s]+(\d+)\s*(?:months?|years?)"))
    provision = F.trim(first((curr, curr), r"\[new\][^\n]*?([^\n]+)")[0])
    return F.array(
        moved(months, "Service period changed: %d → %d months (%s%d months)", F.when(months[1] > months[0], "+").otherwise(""), months[1] - months[0]),
        risen(texts, r"monthly\s*fee[:\s]+\$?([\d,]+)", "Monthly fee changed: $%s → $%s (+$%s)"),
        total(texts, r"total\s*contract\s*value[:\s]+\$?([\d,]+)", "Total contract value changed: $%s → $%s (%s%%)"),
        F.when(provision.isNotNull(), F.concat(F.lit("New provision added: "), provision)),
    )


# fixed values: vital signs as they are named in notes, and how they are read
VITALS = (
    ("Blood Pressure", r"blood\s*pressure[:\s]+(\d+/\d+)"),
    ("Heart Rate", r"heart\s*rate[:\s]+(\d+)\s*bpm"),
    ("Blood Glucose", r"blood\s*glucose[:\s]+(\d+)\s*mg/dl"),
)


def patient_record(texts: Texts) -> Column:
    """Vital signs, said to be improved where the text says so, and the diagnosis."""
    way = F.when(texts[1].contains("[improved]"), "improved").otherwise("changed")
    vital = lambda name, found: F.when(found[0] != found[1], F.format_string("%s %s: %s → %s", F.lit(name), way, *found))
    diagnosis = tuple(F.trim(x) for x in first(texts, r"diagnosis[:\s]+([^\n]+)"))
    return F.array(*[vital(n, first(texts, p)) for n, p in VITALS], moved(diagnosis, "Diagnosis updated: %s → %s"))


def lab_result(texts: Texts) -> Column:
    """Value and status of every test that both texts name."""

    def test(name, old, new):
        moved_in = lambda part, template: F.when(both(old, new) & (old[part] != new[part]), F.format_string(template, name, old[part], new[part]))
        return moved_in("value", "%s changed: %s → %s"), moved_in("state", "%s status: %s → %s")

    return by_key(texts, r"-\s*([^:]+?)[:\s]+([\d.]+%?)\s*(?:mg/dl|%)?\s*(?:\(([^)]+)\))?", ("name", "value", "state"), test)


def any_document(texts: Texts) -> Column:
    """Bracketed marks of change, and the version or revision that the text names."""
    curr = texts[1]
    marks = F.regexp_extract_all(curr, F.lit(r"\[((?:changed|increased|decreased|new)[^\]]*)\]"), F.lit(1))
    noted = F.transform(marks, lambda m: F.concat(F.lit("Change noted: "), F.trim(m)))
    version = first((curr, curr), r"(?:version|revision)[:\s]+(\w+)")[0]
    some = curr.contains("[changed") | curr.contains("[increased")
    return F.concat(F.when(some, noted).otherwise(F.array().cast("array<string>")), F.array(F.when(version.isNotNull(), F.concat(F.lit("Document version: "), version))))


def clean(notes: Column) -> Column:
    """Without nulls, each note once, in order."""
    return F.array_distinct(F.array_compact(notes))


#: Which differences are looked for in which types: by exact names, then by the first word that a type holds; others get any_document.
EXACT = (("purchase order", "change order"), purchase_order)
HOLDING = (
    (("prescription",), prescription), (("offer",), offer_letter), (("proposal",), proposal), (("expense",), expense_report), (("contract",), contract),
    (("patient", "record"), patient_record), (("lab",), lab_result),
)
FORMS = (EXACT[1], *[form for _, form in HOLDING], any_document)


def form_number(doc_type: Column) -> Column:
    """Place in FORMS of the differences for a document type; null for a null type."""
    kind = F.lower(doc_type)
    out = F.when(kind.isin(*EXACT[0]), 0)
    for i, (words, _) in enumerate(HOLDING):
        out = out.when(F.coalesce(*[F.when(kind.contains(w), True) for w in words], F.lit(False)), i + 1)
    return out.otherwise(len(FORMS) - 1)


def content_notes(doc_type: Column, prev: Column, curr: Column) -> Column:
    """Notes of the difference for the document's type; none where a text is empty or null."""
    texts, number = (F.lower(prev), F.lower(curr)), form_number(doc_type)
    notes = F.coalesce(*[F.when(number == i, form(texts)) for i, form in enumerate(FORMS)])
    return F.when((prev != "") & (curr != ""), clean(notes)).otherwise(F.array().cast("array<string>"))


def routed_notes(rows: DataFrame, notes_col: str = "notes") -> DataFrame:
    """rows(doc_type, prev, curr, ...) with content_notes() as notes_col, each type in a branch of its own.

    One expression for all types is too large for generated code and is interpreted for every row; here the
    rows are written once with the number of their form, and each branch reads the rows of its form only.
    """
    marked = checkpoint(rows.withColumns({"_form": form_number(F.col("doc_type")), "_both": F.coalesce((F.col("prev") != "") & (F.col("curr") != ""), F.lit(False))}))
    none = F.array().cast("array<string>")
    texts = (F.lower("prev"), F.lower("curr"))
    parts = [marked.where(F.col("_both") & (F.col("_form") == i)).withColumn(notes_col, clean(form(texts))) for i, form in enumerate(FORMS)]
    parts.append(marked.where(~F.col("_both") | F.col("_form").isNull()).withColumn(notes_col, none))
    return reduce(DataFrame.unionByName, parts).drop("_form", "_both")


def change_records(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(lifecycle_id, revision_key, n, from_file, to_file, details): what each revision changed, from revision_rows() and documents(lifecycle_id, file_name, text).

    Details are the notes of the contents' difference; where there are none, the note on the version, if any. A
    file that is stored more than once counts with its largest text; one without a text gives no content notes.
    """
    texts = documents.groupBy("lifecycle_id", "file_name").agg(F.max("text").alias("text"))
    side = lambda name, column: texts.select("lifecycle_id", F.col("file_name").alias(name), F.col("text").alias(column))
    pairs = revision_changes(rows).withColumn("doc_type", F.substring_index("revision_key", "|", 1))
    both = pairs.join(side("from_file", "prev"), ["lifecycle_id", "from_file"], "left").join(side("to_file", "curr"), ["lifecycle_id", "to_file"], "left")
    noted = routed_notes(both, "_notes")
    details = F.when(F.size("_notes") > 0, F.col("_notes")).otherwise(F.array_compact(F.array("note")))
    return noted.select("lifecycle_id", "revision_key", "n", "from_file", "to_file", details.alias("details"))


def largest_percent(notes: Column) -> Column:
    """Of all percentages that the notes give, the one of the largest size; null without one."""
    found = F.transform(F.regexp_extract_all(F.array_join(notes, "\n"), F.lit(r"([+-]?\d+(?:\.\d+)?)%"), F.lit(1)), lambda x: x.cast("double"))
    return F.aggregate(found, F.lit(None).cast("double"), lambda best, x: F.when(best.isNull() | (F.abs(x) > F.abs(best)), x).otherwise(best))


def revision_sentence(groups: DataFrame) -> DataFrame:
    """(lifecycle_id, summary) of revision groups(lifecycle_id, revision_key, doc_type, revision_count, first_at, last_at)."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    part = F.format_string("%s: %d revision(s) (%s - %s)", F.initcap("doc_type"), "revision_count", day("first_at"), day("last_at"))
    rows = groups.groupBy("lifecycle_id").agg(F.array_sort(F.collect_list(F.struct("revision_key", part.alias("part")))).alias("parts"))
    return rows.select("lifecycle_id", F.array_join(F.transform("parts", lambda p: p["part"]), "; ").alias("summary"))
