"""Entity resolution: stores by fuzzy name, stores by name and address, products by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text
from ..functions.matching import chars, occurrences, token_set
from ..session import kept_in
from .keys import assign_ids, hash_block, next_id, order_block

_TOKEN_SEP = "\u0001"


def _signature(col: Column) -> Column:
    """Sorted characters: names with the same signature have character ratio 1."""
    return F.array_join(F.sort_array(chars(col)), "")


def _keyed(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns(
        {
            "sig": _signature(F.col(col)),
            "tok": F.array_join(token_set(F.col(col)), _TOKEN_SEP),
        }
    )


def _ranked_marks(df: DataFrame, frequency: DataFrame) -> DataFrame:
    """``sig`` and its marks, the rarest of both sides first, by one order for all."""
    marked = df.select("sig", F.explode("marks").alias("mark")).join(frequency, "mark")
    ordered = F.sort_array(F.collect_list(F.struct("n", "mark")))
    return marked.groupBy("sig").agg(F.transform(ordered, lambda m: m["mark"]).alias("marks"))


def _prefix(threshold: float) -> Column:
    """The rarest marks of a name; two names with a ratio of the threshold share one of them.

    A partner has at least threshold / (2 - threshold) as many characters, so the two share
    at least threshold / 2 of that sum; a name can miss no more than the rest of its own.
    """
    n = F.size("marks")
    least = F.ceil(n * (threshold / (2.0 - threshold)) - 1e-9)
    shared = F.ceil((n + least) * (threshold / 2.0) - 1e-9)
    return F.slice("marks", F.lit(1), F.greatest(n - shared + 1, F.lit(1)).cast("int"))


def _near_matches(names: DataFrame, stores: DataFrame, threshold: float) -> DataFrame:
    """Best store per distinct name signature with a character ratio in [threshold, 1).

    Candidates share one of their rarest characters and have lengths that allow the ratio;
    a pair that shares several is taken at the first of them only. Marks carry their places:
    where the first shared marks stand at p and q, no more than the marks behind them can be
    shared as well, so most pairs go before any arrays are compared.
    """
    marks = occurrences(F.split("sig", "")).alias("marks")
    left, right = names.select("sig", marks), stores.select("sig", marks)
    frequency = left.unionByName(right).select(F.explode("marks").alias("mark")).groupBy("mark").agg(
        F.count(F.lit(1)).alias("n")
    )
    wanted = _ranked_marks(left, frequency).withColumn("prefix", _prefix(threshold))
    known = _ranked_marks(right, frequency).withColumn("prefix", _prefix(threshold)).join(stores, "sig")
    keyed = wanted.select(
        "sig", "marks", "prefix", F.size("marks").alias("la"), F.posexplode("prefix").alias("p", "key")
    )
    other = known.select(
        F.col("marks").alias("store_marks"), F.col("prefix").alias("store_prefix"), "store_id", "store_name",
        F.size("marks").alias("lb"), F.posexplode("prefix").alias("q", "store_key"),
    )
    la, lb = F.col("la"), F.col("lb")
    reach = 2.0 * F.least(la - F.col("p"), lb - F.col("q")) >= threshold * (la + lb) - 1e-9
    # The bounds belong to the join, so that rows beyond them are never made.
    met = keyed.join(other, (F.col("key") == F.col("store_key")) & reach)
    pairs = met.filter(F.get(F.array_intersect("prefix", "store_prefix"), F.lit(0)) == F.col("key"))
    score = F.lit(2.0) * F.size(F.array_intersect("marks", "store_marks")) / (la + lb)
    return (
        pairs.withColumn("score", score)
        .filter(F.col("score") >= threshold)
        .groupBy("sig")
        .agg(F.max(F.struct("score", (-F.col("store_id")).alias("neg_id"), F.col("store_name").alias("name"))).alias("best"))
    )


def fuzzy_match_stores(
    names: DataFrame,
    stores: DataFrame,
    threshold: float = V.FUZZY_THRESHOLD,
    token_weight: float = V.TOKEN_WEIGHT,
    work: str | None = None,
) -> DataFrame:
    """Best store per distinct name: (name, matched_store_id, matched_store_name, score).

    The score is the larger of the character ratio and ``token_weight`` times the
    token overlap; the smallest id wins ties; scores below the threshold give no
    match and score 0. Exact: with a threshold of at least ``token_weight`` a token
    match needs equal token sets, and the character join loses no pair. Names are taken
    apart once each, not once per row; with a ``work`` folder the distinct names and stores
    are written there first, as several steps read them and filters on their characters
    would else run on every row of the inputs.
    """
    if threshold < token_weight:
        raise ValueError("threshold below token_weight: token overlap could not be blocked exactly")
    wanted = _keyed(
        names.select(F.col("name").alias("wanted")).filter(F.col("wanted") != "").distinct(), "wanted"
    )
    wanted = kept_in(work, "wanted-names", wanted)
    # The first id of a name; a store without an id comes before all others.
    first_id = F.when(~F.bool_or(F.col("id").isNull()), F.min("id"))
    by_name = stores.filter(F.col("name").isNotNull()).groupBy(F.col("name").alias("store_name")).agg(
        first_id.alias("store_id")
    )
    known = kept_in(work, "known-stores", _keyed(by_name, "store_name"))

    def first_store(key: str) -> DataFrame:
        return known.groupBy(key).agg(F.min(F.struct("store_id", "store_name")).alias("s")).select(
            key, "s.store_id", "s.store_name"
        )

    by_sig = first_store("sig")
    def candidate(score: Column, store_id: str, store_name: str) -> Column:
        return F.when(
            F.col(store_id).isNotNull(),
            F.struct(
                score.alias("score"), (-F.col(store_id)).alias("neg_id"), F.col(store_name).alias("name")
            ),
        )

    tagged = wanted.join(by_sig, "sig", "left")
    open_names = tagged.filter(F.col("store_id").isNull()).select("sig").distinct()
    near = _near_matches(open_names, by_sig, threshold)
    joined = tagged.join(near, "sig", "left")
    options = [
        candidate(F.lit(1.0), "store_id", "store_name"),
        F.col("best"),
    ]
    if token_weight >= threshold:
        by_tok = first_store("tok").filter(F.col("tok") != "").toDF("tok", "tok_id", "tok_name")
        joined = joined.join(by_tok, "tok", "left")
        options.append(candidate(F.lit(float(token_weight)), "tok_id", "tok_name"))
    return joined.withColumn("b", F.greatest(*options)).select(
        F.col("wanted").alias("name"),
        (-F.col("b.neg_id")).alias("matched_store_id"),
        F.col("b.name").alias("matched_store_name"),
        F.coalesce("b.score", F.lit(0.0)).alias("score"),
    )


def resolve_stores(documents: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with store_id and outcome, new store rows).

    documents: doc_id, store_name, branch_address, buyer_address, matched_store_id.
    Order of attempts: matched store with the same address, store of that name and
    address, a new branch; without a branch address the matched store; else a new
    store. New stores are created once per name and address of the batch.
    """
    trim = text.strip
    blank = F.lit("")
    docs = documents.select(
        "doc_id",
        "matched_store_id",
        trim(F.coalesce("store_name", blank)).alias("exact_name"),
        trim(F.coalesce("branch_address", blank)).alias("branch"),
        trim(F.coalesce("buyer_address", blank)).alias("buyer_addr"),
    )
    keyed = stores.select("id", "name", F.trim(F.coalesce("address", blank)).alias("addr"))
    by_id = keyed.select(F.col("id").alias("matched_store_id"), F.col("addr").alias("matched_addr"))
    by_pair = keyed.groupBy(F.col("name").alias("exact_name"), F.col("addr").alias("branch")).agg(
        F.min("id").alias("pair_id")
    )
    tried = docs.join(by_id, "matched_store_id", "left").join(by_pair, ["exact_name", "branch"], "left")
    has_id, has_addr = F.col("matched_store_id").isNotNull(), F.col("branch") != ""
    outcome = (
        F.when(has_id & has_addr & (F.col("matched_addr") == F.col("branch")), "same_id_address")
        .when(has_id & has_addr & F.col("pair_id").isNotNull(), "same_name_address")
        .when(has_id & has_addr, "new_branch")
        .when(has_id, "matched_name")
        .otherwise("new_store")
    )
    name = F.when(F.col("exact_name") == "", F.lit(V.UNKNOWN_BUYER)).otherwise(F.col("exact_name"))
    new_addr = F.when(has_addr, F.col("branch")).otherwise(
        F.when(~has_id, F.col("buyer_addr")).otherwise(blank)
    )
    decided = tried.select(
        "doc_id",
        outcome.alias("outcome"),
        "matched_store_id",
        "pair_id",
        name.alias("name"),
        new_addr.alias("addr"),
    )
    is_new = F.col("outcome").isin("new_branch", "new_store")
    fresh = assign_ids(
        decided.filter(is_new).select("name", "addr").distinct(),
        [hash_block("name", "addr")],
        ["name", "addr"],
        next_id(stores),
    )
    linked = decided.join(fresh.withColumnRenamed("id", "new_id"), ["name", "addr"], "left").select(
        "doc_id",
        F.when(is_new, F.col("new_id"))
        .when(F.col("outcome") == "same_name_address", F.col("pair_id"))
        .otherwise(F.col("matched_store_id"))
        .alias("store_id"),
        "outcome",
    )
    rows = fresh.select("id", "name", F.nullif("addr", blank).alias("address"))
    return linked, rows


def new_products(items: DataFrame, products: DataFrame, work: str | None = None) -> DataFrame:
    """Products to create: one per new trimmed name, first price as default.

    items: doc_id, line_no, name, unit_price. Ids follow the first appearance.
    """
    named = items.withColumn("name", text.strip(F.col("name"))).filter(F.col("name") != "")
    first = named.groupBy("name").agg(
        F.min(F.struct("doc_id", "line_no", "unit_price")).alias("first")
    )
    missing = first.join(products.select("name"), "name", "left_anti").select(
        "name",
        F.lit(V.DEFAULT_UNIT).alias("unit"),
        F.col("first.unit_price").alias("default_unit_price"),
        F.col("first.doc_id").alias("first_doc"),
        F.col("first.line_no").alias("first_line"),
    )
    return assign_ids(
        missing, [order_block("first_doc")], ["first_doc", "first_line", "name"], next_id(products), work=work
    ).select("id", "name", "unit", "default_unit_price")


def link_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """Add product_id by exact trimmed name; the smallest id when a name repeats."""
    by_name = products.groupBy(F.col("name").alias("_key")).agg(F.min("id").alias("product_id"))
    return items.withColumn("_key", text.strip(F.col("name"))).join(by_name, "_key", "left").drop("_key")


def fill_store_addresses(stores: DataFrame, documents: DataFrame) -> DataFrame:
    """Drop head-office addresses, then fill blank ones from the first document that has one.

    documents: doc_id, matched_store_id, branch_address. An address is never overwritten.
    """
    offered = documents.filter(
        F.col("matched_store_id").isNotNull()
        & (F.coalesce("branch_address", F.lit("")) != "")
        & ~text.is_hq_address(F.col("branch_address"))
    )
    first = offered.groupBy(F.col("matched_store_id").alias("id")).agg(
        F.min_by(text.strip(F.col("branch_address")), "doc_id").alias("offer")
    )
    kept = stores.withColumn("address", text.reset_hq_address(F.col("address")))
    is_blank = text.strip(F.coalesce("address", F.lit(""))) == ""
    return (
        kept.join(first, "id", "left")
        .withColumn("address", F.when(is_blank, F.coalesce("offer", "address")).otherwise(F.col("address")))
        .drop("offer")
        .select(*stores.columns)
    )


def store_address_status(stores: DataFrame) -> DataFrame:
    """Final list: ok when an address is present and not the head office."""
    return stores.select(
        "id", text.address_status(F.col("address")).alias("status"), "address", "name"
    ).orderBy("name", "id")
