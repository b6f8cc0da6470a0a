"""Model names: listing them, proposing canonical names, and renaming to them."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forecourt import schemas as S
from forecourt.plans.joins import BROADCAST_ROWS, contains_join, keyed_join, materialize


def distinct_models(df: DataFrame) -> DataFrame:
    """Distinct (manufacturer, model) pairs without nulls, sorted."""
    return df.select("manufacturer", "model").dropna().distinct().orderBy("manufacturer", "model")


def model_counts(df: DataFrame) -> DataFrame:
    """Listings per (manufacturer, model), manufacturer descending, frequent models first."""
    return (
        df.select("manufacturer", "model").dropna()
        .groupBy("manufacturer", "model").agg(F.count("*").alias("n"))
        .orderBy(F.desc("manufacturer"), F.desc("n"), "model")
    )


def dictionary_frame(spark: SparkSession, names: dict[str, list[str]]) -> DataFrame:
    """``{manufacturer: [canonical names in order]}`` as a dictionary table."""
    rows = [(maker, pos, name) for maker, listed in names.items() for pos, name in enumerate(listed)]
    return spark.createDataFrame(rows, S.DICTIONARY)


def propose_dictionary(df: DataFrame, min_count: int = 2) -> DataFrame:
    """Canonical names read off the data: the leading words of model names.

    A word is kept if it leads at least ``min_count`` listings of the manufacturer, however
    many listings there are. Longer names come first, so that a name is not rewritten
    by a shorter one it contains before it was used.
    """
    listed = df.select("manufacturer", "model").dropna()
    word = F.split(F.lower("model"), " ")[0]
    names = (
        listed.groupBy("manufacturer", word.alias("canonical")).agg(F.count("*").alias("n"))
        .filter((F.col("n") >= min_count) & (F.col("canonical") != ""))
    )
    order = Window.partitionBy("manufacturer").orderBy(F.desc(F.length("canonical")), F.desc("n"), "canonical")
    return names.select("manufacturer", (F.row_number().over(order) - 1).alias("pos"), "canonical", "n")


def propose_base_names(df: DataFrame, min_count: int = 2, max_words: int = 4, dominance: float = 0.9) -> DataFrame:
    """Canonical names of one to ``max_words`` words, read off how model names go on: (manufacturer, pos, canonical, n).

    The words of a manufacturer's model names, lower-cased, form a tree of beginnings. A beginning branches if at least
    ``min_count`` listings have it and it goes on in several ways, none of which (the end is one) takes more than the share
    ``dominance`` of them. The shortest beginnings that branch are base names: "grand cherokee" goes on as laredo, limited or
    not at all, but "grand" nearly always as cherokee. A name of ``min_count`` listings or more that never branches is
    one itself, up to ``max_words`` words. Longer names come first, by ``pos``, which is the same for names of equal length.

    Counted by beginning and combined per task, so that neither a manufacturer nor a name gathers its listings.
    """
    listed = df.select("manufacturer", F.lower(F.btrim("model", F.lit(" \t\n\r\x0b\x0c"))).alias("name")).dropna().filter("name <> ''")
    counted = listed.groupBy("manufacturer", "name").agg(F.count("*").alias("n"))
    words = F.split("name", r"\s+")
    lengths = F.sequence(F.lit(1), F.least(F.size("words"), F.lit(max_words)))
    begun = counted.select("manufacturer", "n", words.alias("words")).select("manufacturer", "n", "words", F.explode(lengths).alias("length"))
    begun = begun.select(
        "manufacturer", "n", F.slice("words", F.lit(1), F.col("length")).alias("beginning"), F.get("words", F.col("length")).alias("next"),
        ((F.col("length") == max_words) | (F.col("length") == F.size("words"))).alias("whole"),
    )
    ways = begun.groupBy("manufacturer", "beginning", "next").agg(F.sum("n").alias("n"), F.max("whole").alias("whole"))
    tree = materialize(ways.groupBy("manufacturer", "beginning").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("ways"), F.max("whole").alias("whole")))
    branches = (F.col("n") >= min_count) & (F.col("ways") > 1) & (F.col("most") <= F.lit(dominance) * F.col("n"))
    branching = tree.filter(branches).select("manufacturer", F.col("beginning").alias("shorter"))
    possible = tree.filter((F.col("n") >= min_count) & (branches | F.col("whole")))
    shorter = F.filter(F.transform("beginning", lambda _, i: F.slice("beginning", F.lit(1), i)), lambda part: F.size(part) > 0)
    after = (
        possible.select("manufacturer", "beginning", F.explode(shorter).alias("shorter"))
        .join(branching, ["manufacturer", "shorter"], "left_semi").select("manufacturer", "beginning").distinct()
    )
    name = F.array_join("beginning", " ")
    bases = possible.join(after, ["manufacturer", "beginning"], "left_anti")
    return bases.select("manufacturer", (F.lit(1_000_000) - F.length(name)).cast("int").alias("pos"), name.alias("canonical"), "n")


def normalize_models(
    df: DataFrame, dictionary: DataFrame, mode: str = "literal", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rewrite ``model`` to the canonical names of its manufacturer.

    The names apply in dictionary order, each to the value the earlier ones left: where
    the value contains the name (ignoring case) it becomes the name. ``mode="regex"``
    reads the names as Java regular expressions.

    Works on distinct names: the first name that a model holds is looked up by grams, and from there only names follow names, which
    is solved once for the dictionary alone. Listings then take their name by equality, not shuffled
    while the distinct names are few, which is checked. Regular expressions are tried one after the other on each distinct name.
    """
    if mode not in ("literal", "regex"):
        raise ValueError(f"mode must be literal or regex, not {mode!r}")
    named = df.select("manufacturer", "model").dropna().distinct()
    names = dictionary.filter(F.col("canonical").isNotNull()).select("manufacturer", "pos", "canonical")
    renamed = materialize(_renamed(named, names) if mode == "literal" else _renamed_by_patterns(named, names, max_rows))
    joined = keyed_join(df, renamed, ["manufacturer", "model"], "left", max_rows=max_rows)
    model = F.coalesce("_renamed", "model").alias("model")
    return joined.select(*[model if c == "model" else F.col(f"`{c}`") for c in df.columns])


def _renamed(named: DataFrame, names: DataFrame) -> DataFrame:
    """(manufacturer, model, _renamed) of the distinct names that hold a canonical one."""
    places = materialize(names.distinct().select("manufacturer", F.struct("pos", "canonical").alias("_at"), F.lower("canonical").alias("_low")))
    models = named.withColumn("_text", F.lower("model"))
    makers = ("manufacturer",)
    texts = models.select("manufacturer", "_text").distinct()
    held = contains_join(places, texts, "_low", "_text", on=makers)
    first = materialize(held.groupBy("manufacturer", "_text").agg(F.min("_at").alias("_at")))
    # A name gives way to the first later one that it holds, and so on: every name's way is doubled until all have ended.
    among = contains_join(places, places.select("manufacturer", F.col("_low").alias("_text")).distinct(), "_low", "_text", on=makers)
    later = places.select("manufacturer", F.col("_at").alias("_from"), F.col("_low").alias("_text"))
    to = keyed_join(later, among.select("manufacturer", "_text", "_at"), ["manufacturer", "_text"]).filter(F.col("_at") > F.col("_from"))
    ways = materialize(to.groupBy("manufacturer", "_from").agg(F.min("_at").alias("_to")))
    while True:
        on = ways.select("manufacturer", F.col("_from").alias("_to"), F.col("_to").alias("_on"))
        further = ways.join(on, ["manufacturer", "_to"], "left")
        if further.filter(F.col("_on").isNotNull()).isEmpty():
            break
        ways = materialize(further.select("manufacturer", "_from", F.coalesce("_on", "_to").alias("_to")))
    ends = first.join(ways.withColumnRenamed("_from", "_at"), ["manufacturer", "_at"], "left")
    ends = ends.select("manufacturer", "_text", F.coalesce("_to", "_at")["canonical"].alias("_renamed"))
    return models.join(ends, ["manufacturer", "_text"]).select("manufacturer", "model", "_renamed")


def _renamed_by_patterns(named: DataFrame, names: DataFrame, max_rows: int) -> DataFrame:
    """The same by regular expressions, folded over each distinct name's patterns."""
    listed = materialize(names.groupBy("manufacturer").agg(F.array_sort(F.collect_list(F.struct("pos", "canonical"))).alias("_names")))

    def apply_name(value, name):
        return F.when(F.regexp_like(value, F.concat(F.lit("(?iu)"), name["canonical"])), name["canonical"]).otherwise(value)

    joined = keyed_join(named, listed, ["manufacturer"], max_rows=max_rows)
    return joined.select("manufacturer", "model", F.aggregate("_names", F.col("model"), apply_name).alias("_renamed"))
