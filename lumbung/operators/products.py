"""Products: feed normalisation, data set choice and matching to institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions.matching import let
from lumbung.functions.numbers import money
from lumbung.functions.text import split_list
from lumbung.functions.web import slug
from lumbung.operators.status import product_category
from lumbung.rules import outreach as R
from lumbung.session import cut_lineage

# ---- fixed values: alternative field names of product feeds -----------------------------------
FEED_FIELDS = {
    "provider": (["provider", "providerName", "nama_penyedia"], "Pending provider verification"),
    "principal": (["principal", "principalName", "nama_prinsipal"],
                  "Pending principal verification"),
    "brand": (["brand", "merek"], "Pending brand verification"),
    "price": (["price", "harga"], "Pending price verification"),
    "tkdn": (["tkdn"], "Pending TKDN verification"),
    "certificate": (["certificate", "sertifikat"], "Pending certificate verification"),
    "specification": (["specification", "spesifikasi"], "Pending specification verification"),
    "source_url": (["source_url", "url"], ""),
    "photo_url": (["photo_url", "image", "foto"], ""),
}
FEED_NAME = ["name", "productName", "nama_produk", "product_name"]
FEED_ID = ["id", "product_id", "kode_produk"]
FEED_CATEGORY = ["category", "kategori"]
FEED_SUBCATEGORY = ["subcategory", "subkategori"]
FEED_NAME_DEFAULT = "product pending verification"
FEED_SOURCE = "INAPROC_SYNC_V1"
FEED_EVIDENCE = "INAPROC_PENDING_VERIFICATION"
FEED_STATUS = "SYNCED_PENDING_VERIFICATION"
SEED_SOURCE = "MANUAL_SEED_V1"
# ---- end of fixed values ----------------------------------------------------------------------


def normalize_feed(feed: DataFrame, synced_at: str) -> DataFrame:
    """Feed rows with any of the alternative field names, as product rows with defaults."""
    def field(names: list[str]) -> Column:
        present = [F.trim(F.col(f"`{n}`").cast("string")) for n in names if n in feed.columns]
        return F.coalesce(*present, F.lit(""))

    def or_default(value: Column, default: Column | str) -> Column:
        return F.when(value != "", value).otherwise(default)

    name = or_default(field(FEED_NAME), FEED_NAME_DEFAULT)
    category = product_category(F.concat_ws(" ", name, field(FEED_CATEGORY),
                                            field(FEED_SUBCATEGORY)))
    made_id = slug(name, 90)
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return feed.select(
        or_default(field(FEED_ID), F.concat(F.lit("catalog-"), F.when(
            made_id != "", made_id).otherwise("product"))).alias("id"),
        name.alias("name"), category.alias("category"),
        or_default(field(FEED_SUBCATEGORY), category).alias("subcategory"),
        *[or_default(field(names), default).alias(c)
          for c, (names, default) in FEED_FIELDS.items()],
        F.array_distinct(F.concat(F.array(F.lower(category)), words)).alias("keywords"),
        F.lit(FEED_EVIDENCE).alias("evidence_status"), F.lit(FEED_SOURCE).alias("source"),
        F.lit(synced_at).alias("synced_at"), F.lit(FEED_STATUS).alias("status"))


def seed_products(spark: SparkSession) -> DataFrame:
    """The fixed product lines, as product rows."""
    rows = spark.createDataFrame(R.PRODUCT_LINES, "id string, category string, "
                                                  "keywords array<string>")
    return rows.withColumns({"source": F.lit(SEED_SOURCE), "synced_at": F.lit(SEED_SOURCE),
                             "evidence_status": F.lit(SEED_SOURCE)})


def product_data_set(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """Stored products if there are any, else the seed lines."""
    columns = [c for c in seed.columns if c in stored.columns]
    has_stored = stored.limit(1).agg(F.count("*") > 0).scalar()
    both = stored.select(*columns, F.lit(False).alias("_seed")).unionByName(
        seed.select(*columns, F.lit(True).alias("_seed")))
    return both.where(F.col("_seed") != has_stored).withColumn(
        "using_seed_fallback", F.col("_seed")).drop("_seed")


def latest_sync(products: DataFrame) -> DataFrame:
    return products.agg(F.coalesce(F.max("synced_at"), F.lit("")).alias("synced_at"))


# ---- matching --------------------------------------------------------------------------------
def _needs(products: DataFrame) -> DataFrame:
    aliases = F.create_map(*[x for c, names in R.CATEGORY_ALIASES.items()
                             for x in (F.lit(c), F.array(*map(F.lit, names)))])
    return products.select(F.col("id").alias("product_id"), F.explode(
        F.try_element_at(aliases, F.col("category"))).alias("need"))


def _keywords(products: DataFrame) -> DataFrame:
    return products.select(F.col("id").alias("product_id"), F.explode("keywords").alias("k")
                           ).select("product_id", F.lower("k").alias("keyword")).distinct()


GRAM = 4
FEW_KEYWORDS = 200


def _runs(text: Column, lengths: range) -> Column:
    """Distinct runs of the given numbers of characters of a text."""
    def runs(letters: Column, n: int) -> Column:
        # Runs that would reach beyond the end are null and dropped.
        return F.array_compact(F.transform(letters, lambda c, i: F.concat(
            c, *[F.get(letters, i + k) for k in range(1, n)])))

    return F.array_distinct(F.flatten(let(F.split(text, ""), lambda letters: F.array(
        *[runs(letters, n) for n in lengths]))))


def _anchored(words: DataFrame) -> DataFrame:
    """Each keyword with its run of four characters (shorter ones: all of it) that the fewest
    keywords have, so that keywords with a common beginning are told apart."""
    runs = words.select("keyword", F.explode(F.when(
        F.length("keyword") < GRAM, F.array("keyword")).otherwise(
        _runs(F.col("keyword"), range(GRAM, GRAM + 1)))).alias("_gram"))
    counts = runs.groupBy("_gram").agg(F.count("*").alias("_n"))
    return runs.join(counts, "_gram").groupBy("keyword").agg(
        F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))


def keyword_hits(rows: DataFrame, row_id: str, text: str, keywords: DataFrame) -> DataFrame:
    """(row id, keyword) of every keyword contained in the row's text.

    A text that contains a keyword contains each of its runs of characters, so rows and keywords
    meet on the keywords' rarest runs, and only these pairs are compared in full. Texts stay with
    their rows until then. Row ids are distinct. Keywords that were counted to be few are sent to
    all tasks instead: looking for each of them in a text is then less work than its runs.
    """
    words = keywords.select("keyword").where("keyword <> ''").distinct()
    if words.limit(FEW_KEYWORDS + 1).count() <= FEW_KEYWORDS:
        return rows.select(row_id, text).join(F.broadcast(words), F.col(text).contains(
            F.col("keyword"))).select(row_id, "keyword")
    met = rows.select(row_id, F.explode(_runs(F.col(text), range(1, GRAM + 1))).alias(
        "_gram")).join(_anchored(words), "_gram").select(row_id, "keyword")
    return rows.select(row_id, text).join(met, row_id).where(
        F.col(text).contains(F.col("keyword"))).select(row_id, "keyword")


def institution_signatures(prospects: DataFrame) -> DataFrame:
    """Institutions grouped by what matching looks at: their categories and text.

    Institutions that agree on both match the same products, so products meet signatures, not
    institutions. They are written out, because matching reads them several times.
    """
    text = F.lower(F.concat(F.coalesce("relevant_categories", F.lit("")), F.lit(" "),
                            F.coalesce("example_package_names", F.lit(""))))
    return cut_lineage(prospects.withColumn("_text", text).withColumn(
        "signature", F.sha2(F.concat_ws("\u001f", "relevant_categories", "_text"), 256)))


def signature_matches(products: DataFrame, signatures: DataFrame) -> DataFrame:
    """(product, signature) pairs: a shared category or a contained keyword."""
    shapes = signatures.groupBy("signature").agg(
        F.any_value("relevant_categories").alias("relevant_categories"),
        F.any_value("_text").alias("_text"))
    by_category = shapes.select("signature", F.explode(split_list(F.col(
        "relevant_categories"))).alias("need")).join(_needs(products), "need").select(
        "product_id", "signature")
    words = _keywords(products)
    by_keyword = keyword_hits(shapes, "signature", "_text", words).join(words, "keyword").select(
        "product_id", "signature")
    return by_category.unionByName(by_keyword).distinct()


def match_products(products: DataFrame, prospects: DataFrame) -> DataFrame:
    """(product, institution, budget) for every match."""
    signed = institution_signatures(prospects)
    pairs = signature_matches(products, signed)
    return signed.select("signature", "institution_name", "institution_display_name",
                         "total_pagu", "example_package_names").join(pairs, "signature").drop(
        "signature")


def product_summary(products: DataFrame, prospects: DataFrame) -> DataFrame:
    """Matched institutions and budget per product (an institution may count for several)."""
    signed = institution_signatures(prospects)
    weight = signed.groupBy("signature").agg(F.count("*").alias("n"),
                                             F.sum(money(F.col("total_pagu"))).alias("pagu"))
    pairs = signature_matches(products, signed).join(weight, "signature")
    per = pairs.groupBy("product_id").agg(F.sum("n").alias("n"), F.sum("pagu").alias("pagu"))
    return products.select(F.col("id").alias("product_id"), "category").join(
        per, "product_id", "left").select(
        "product_id", "category", F.coalesce("n", F.lit(0)).alias("matched_institutions"),
        F.coalesce(F.col("pagu").cast("double"), F.lit(0.0)).alias("matched_pagu"))


def product_examples(products: DataFrame, prospects: DataFrame, per_institution: int = 3
                     ) -> DataFrame:
    """Up to three example packages per matched (product, institution)."""
    matches = match_products(products, prospects)
    items = F.slice(split_list(F.col("example_package_names"), "|"), 1, per_institution)
    return matches.select("product_id", "institution_name", F.posexplode(items).alias(
        "position", "package_name"))


def product_kpis(products: DataFrame, prospects: DataFrame) -> DataFrame:
    """Categories, matched institutions and their budget, each institution counted once."""
    signed = institution_signatures(prospects)
    matched = signature_matches(products, signed).select("signature").distinct()
    hit = signed.join(matched, "signature", "left_semi")
    kinds = products.agg(F.count_distinct("category")).scalar()
    return hit.agg(F.count("*").alias("matched_institutions"),
                   F.coalesce(F.sum(money(F.col("total_pagu"))), F.lit(0)).cast("double").alias(
                       "matched_pagu")).withColumn("categories", kinds)

