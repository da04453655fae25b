"""Pages to records, and changes between snapshots: extraction, dedup, triage, guards, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character references that texts hold most: fixed values.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
DROPPED = ("script", "style", "noscript", "template")
BLOCKS = "p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title"


def html_text(html: Column) -> Column:
    """Visible text: dropped elements and comments out, block tags to line feeds, entities decoded, blanks collapsed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(out, r"^\n+|\n+$", ""))


def links(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, place, href, label) of every link."""
    pattern = r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    rows = pages.select(*keys, F.posexplode(F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"))).alias("place", "a"))
    return rows.select(*keys, "place", F.col("a.href").alias("href"), F.regexp_replace("a.label", r"<[^>]*>", "").alias("label"))


def table_rows(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, row, cells): cells of every table row as texts."""
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "__r"))
    cells = F.transform(F.regexp_extract_all("__r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), html_text)
    return rows.select(*keys, "row", cells.alias("cells"))


def price_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, price) of table rows: the first cell and the last cell that reads as a number."""
    number = F.filter(F.transform("cells", lambda x: F.regexp_replace(F.regexp_extract(x, r"^\D{0,5}(\d[\d  ]*)\D{0,5}$", 1), r"[  ]", "").try_cast("long")), lambda x: x.isNotNull())
    priced = rows.select(*keys, F.try_element_at("cells", F.lit(1)).alias("name"), F.try_element_at(number, F.lit(-1)).alias("price"))
    return priced.where("price is not null and name <> ''")


def json_ld(pages: DataFrame, keys: list[str], html: str, schema: str) -> DataFrame:
    """(keys, item): JSON-LD objects, single, in lists or under @graph."""
    blocks = pages.select(*keys, F.explode(F.regexp_extract_all(html, F.lit(r'(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))).alias("__b"))
    graph = F.get_json_object("__b", "$.@graph")
    many = F.from_json(F.coalesce(graph, F.col("__b")), f"array<{schema}>")
    one = F.array(F.from_json("__b", schema))
    listed = F.trim("__b").startswith("[") | graph.isNotNull()
    return blocks.select(*keys, F.explode(F.when(listed, many).otherwise(one)).alias("item")).where("item is not null")


def triage(changes: DataFrame, baseline: Column, field: str = "price", tolerance: float = 0.2) -> DataFrame:
    """decision: prices within the tolerance of the approved baseline pass by themselves, all else is reviewed."""
    now = F.col("after").try_cast("double")
    near = F.abs(now - baseline) <= baseline * F.lit(tolerance)
    return changes.withColumn("decision", F.when((F.col("change") == "changed") & (F.col("field") == field) & F.coalesce(near, F.lit(False)), "auto").otherwise("review"))


def mass_change(changes: DataFrame, group: list[Column], previous: DataFrame, share: float = 0.5, least: int = 3, most_added: int = 30) -> DataFrame:
    """suspicious: over half of a group's rows (and at least three) gone, or more added than there were and than most_added.

    previous: the group columns and n, its rows before.
    """
    names = [c for c in previous.columns if c != "n"]
    counts = changes.groupBy(*group).agg(F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.col("change") == "added").alias("added"))
    joined = previous.join(counts, names, "left").fillna(0, ["removed", "added"])
    gone = (F.col("removed") >= least) & (F.col("removed") > F.col("n") * F.lit(share))
    return joined.withColumn("suspicious", gone | (F.col("added") > F.greatest(F.col("n"), F.lit(most_added))))


def apply_changes(current: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """The table after accepted rows (all columns of current, and `deleted`) replace, add or remove theirs."""
    kept = current.join(accepted.select(*keys), keys, "left_anti")
    return kept.unionByName(accepted.where("NOT deleted").select(*current.columns))


def changed_pages(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of `after` whose content hash differs from the one before, or that are new."""
    old = before.select(key, F.sha2(content, 256).alias("__old"))
    return after.join(old, key, "left").where(~F.sha2(F.col(content), 256).eqNullSafe(F.col("__old"))).drop("__old")


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """reason: the name of the first check that holds, null for valid rows."""
    reason = F.lit(None).cast("string")
    for name, failed in reversed(checks.items()):
        reason = F.when(F.coalesce(failed, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def merge_records(rows: DataFrame, identity: list[str], sets: dict[str, str], least: dict[str, str]) -> DataFrame:
    """One record per identity: value sets gathered (sorted), the least of others, and how many rows made it."""
    gathered = [F.sort_array(F.collect_set(c)).alias(n) for n, c in sets.items()]
    return rows.groupBy(*identity).agg(*gathered, *[F.min(c).alias(n) for n, c in least.items()], F.count(F.lit(1)).alias("n"))


def person_on_page(text: Column, surname: Column, first: Column) -> Column:
    """The name stands on the page in either order, or the surname with the initial; false without both parts."""
    page = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    s, f = F.lower(surname), F.lower(first)
    holds = lambda *parts: F.contains(page, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    found = holds(" ", s, " ", f) | holds(" ", f, " ", s, " ") | holds(" ", s, " ", F.substring(f, 1, 1), " ")
    return F.coalesce((s != "") & (f != "") & found, F.lit(False))


def verify_on_pages(people: DataFrame, pages: DataFrame, key: str, url: str, html: str, surname: str, first: str) -> DataFrame:
    """(key, status) of people with a web address: present, missing, or unreachable where no page of that address has text."""
    listed = people.where(F.col(url).rlike("^https?://"))
    texts = pages.select(url, html_text(F.col(html)).alias("__t"))
    found = listed.join(texts, url, "left")
    # a page more than one row: present on any counts
    marked = found.select(key, F.when(F.coalesce(F.col("__t"), F.lit("")) == "", 0).when(person_on_page(F.col("__t"), F.col(surname), F.col(first)), 2).otherwise(1).alias("__s"))
    status = F.element_at(F.array(F.lit("unreachable"), F.lit("missing"), F.lit("present")), F.max("__s") + 1)
    return marked.groupBy(key).agg(status.alias("status"))


def parse_guard(people: Column, prices: Column, unmatched: Column, has_place: Column, most_people: int, most_prices: int, most_unmatched: int) -> Column:
    """too_many_records, parse_empty, or ok: pages that read as too much or as nothing go to review whole."""
    return F.when((people > most_people) | (prices > most_prices) | (unmatched > most_unmatched), "too_many_records").when(~has_place & (people == 0) & (prices == 0), "parse_empty").otherwise("ok")


def aliases(name: Column, table: dict[str, list[str]], excluded: dict[str, list[str]]) -> Column:
    """Aliases of a name that holds the alias or one of its long forms, and none of the alias's exclusions; sorted, all forms."""
    key = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")
    out = F.array().cast("array<string>")
    for alias, forms in table.items():
        holds = F.contains(key, F.lit(alias))
        for form in forms:
            holds = holds | F.contains(key, F.lit(form.replace(" ", "")))
        for stop in excluded.get(alias, []):
            holds = holds & ~F.contains(key, F.lit(stop))
        out = F.concat(out, F.when(holds, F.array(*[F.lit(x) for x in (alias, *forms)])).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(out))


def cleaned(text: Column, most: int) -> Column:
    """At most `most` characters without control characters, blanks collapsed and trimmed."""
    plain = F.regexp_replace(F.substring(text, 1, most), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.trim(F.regexp_replace(plain, r"[ \t]+", " "))


def apply_prices(current: DataFrame, decided: DataFrame, key: str, price: str = "price") -> DataFrame:
    """Prices after the changes that were decided 'auto'; baseline, the last price a person approved, stays, so drift adds up against it."""
    auto = decided.where("decision = 'auto'").select(key, F.col("after").cast("long").alias("__new"))
    joined = current.join(auto, key, "left")
    return joined.withColumn("changed", F.coalesce(F.col("__new") != F.col(price), F.lit(False))).withColumn(price, F.coalesce("__new", price)).drop("__new")
