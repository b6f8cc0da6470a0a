"""Repair cost lookup in a price list, for one request or a whole table of requests."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.text import any_of, coerce_components, contains_ci, repair_terms
from forecourt.plans.joins import contains_join, keyed_join, materialize

_ROW = ["component", "diagnostic", "reparation_cost"]
_MARK = "\u0000"


def repairs_for(
    catalog: DataFrame,
    diagnosis: str | None = None,
    components: list[str] | str | None = None,
    like_wildcards: bool = False,
    cap: int | None = None,
) -> DataFrame:
    """Price list rows for one request: any component or the diagnosis found in either text column.

    Without input every row matches. ``cap`` keeps the first rows in (component,
    diagnostic, cost) order.
    """
    listed = [components] if isinstance(components, str) else list(components or [])
    terms = [t.strip().lower() for t in listed + ([diagnosis] if diagnosis else [])]
    tests = [contains_ci(F.col(c), t, like_wildcards) for t in terms for c in ("component", "diagnostic")]
    rows = (catalog.filter(any_of(tests)) if tests else catalog).select(*_ROW)
    return rows if cap is None else rows.orderBy(*_ROW).limit(cap)


def _needs(requests: DataFrame, request_id: str) -> DataFrame:
    """(request_id, _terms). A request without input searches for "", which is in every row;
    a blank term searches for the mark that every row with any text has."""
    listed = coerce_components(requests)
    terms = F.transform(
        repair_terms(F.col("diagnosis"), F.col("components")),
        lambda t: F.when(t == "", F.lit(_MARK)).otherwise(t),
    )
    return listed.select(request_id, F.when(F.size(terms) == 0, F.array(F.lit(""))).otherwise(terms).alias("_terms"))


def _asked_terms(sets: DataFrame, min_word: int | None) -> DataFrame:
    """(_terms, relax_tier, _of, _term): the terms of a set, and as rung 1 their words, each with the term it is of."""
    own = sets.select("_terms", F.lit(0).alias("relax_tier"), F.explode("_terms").alias("_of")).withColumn("_term", F.col("_of"))
    if min_word is None:
        return own
    words = F.array_distinct(F.filter(F.split("_of", r"\s+"), lambda w: F.length(w) >= min_word))
    return own.unionByName(own.select("_terms", F.lit(1).alias("relax_tier"), "_of", F.explode(words).alias("_term")))


def _text() -> Column:
    """Both text columns in lower case, a mark before each; "" when both are null."""
    part = lambda c: F.concat(F.lit(_MARK), F.lower(c))
    return F.concat_ws("", part("component"), part("diagnostic"))


def _heaviest(words: DataFrame, by_term: DataFrame, rows: DataFrame) -> DataFrame:
    """(_terms, relax_tier, _signature): the rows that hold the most weight of a term's words, for each term of a set.

    A word's weight is the logarithm of rows by rows that hold it, in thousandths. A row's words are its signature's, so
    words are counted and weighed on signatures; what does not fit any row is what weighs least in all.
    """
    total = rows.agg(F.sum("copies")).first()[0] or 0
    held = rows.groupBy("_signature").agg(F.sum("copies").alias("n")).select("n", F.explode("_signature").alias("_term"))
    weight = F.greatest(F.round(F.ln(F.lit(total + 1.0) / F.sum("n")) * 1000).cast("long"), F.lit(1).cast("long"))
    weighed = keyed_join(words, materialize(held.groupBy("_term").agg(weight.alias("_weight"))), ["_term"])
    term = ["_terms", "relax_tier", "_of"]
    sums = materialize(keyed_join(weighed, by_term, ["_term"]).groupBy(*term, "_signature").agg(F.sum("_weight").alias("_weight")))
    most = sums.groupBy(*term).agg(F.max("_weight").alias("_weight"))
    return sums.join(most, [*term, "_weight"]).select("_terms", "relax_tier", "_signature")


def _lookup(requests: DataFrame, catalog: DataFrame, request_id: str, min_word: int | None, rarest: bool):
    """Requests with their term set, term sets with the signatures that answer them, and signed rows.

    The signature of a price list row is the sorted list of asked terms found in it. Rows
    share few distinct signatures, so term sets meet signatures instead of rows. A text of
    n characters contains at most n(n+1)/2 terms, which bounds a signature. A term set is
    answered on its first rung with any match.
    """
    needs = _needs(requests, request_id)
    asked = materialize(_asked_terms(needs.select("_terms").distinct(), min_word))
    rows = catalog.groupBy(*_ROW).agg(F.count("*").alias("copies")).withColumn("_text", _text())
    found = contains_join(asked.select("_term").distinct(), rows.select("_text").distinct(), "_term", "_text")
    signed = materialize(found.groupBy("_text").agg(F.array_sort(F.collect_set("_term")).alias("_signature")))

    by_term = signed.select("_signature").distinct().select("_signature", F.explode("_signature").alias("_term"))
    hit = asked.join(by_term.select("_term").distinct(), "_term", "left_semi")
    rung = hit.groupBy("_terms").agg(F.min("relax_tier").alias("relax_tier"))
    live = hit.join(rung, ["_terms", "relax_tier"])
    rows = keyed_join(rows, signed, ["_text"]).drop("_text")
    whole = live.filter("relax_tier = 0") if rarest else live
    answers = keyed_join(whole, by_term, ["_term"]).select("_terms", "relax_tier", "_signature")
    if rarest and min_word is not None:
        rows = materialize(rows)
        answers = answers.unionByName(_heaviest(live.filter("relax_tier = 1"), by_term, rows))
    return needs, answers.distinct(), rows


def _set_name() -> Column:
    """A term set as text, its terms in order; "" for requests without input, two quotes for a blank term."""
    return F.array_join(F.transform("_terms", lambda t: F.when(t == _MARK, '""').otherwise(t)), "; ").alias("term_set")


def request_term_sets(requests: DataFrame, request_id: str = "request_id") -> DataFrame:
    """(request_id, term_set) of every request; ``match_repairs`` has the rows of each set."""
    return _needs(requests, request_id).select(request_id, _set_name())


def match_repairs(
    requests: DataFrame,
    catalog: DataFrame,
    request_id: str = "request_id",
    min_word: int | None = None,
    rarest: bool = False,
) -> DataFrame:
    """Every price list row that answers each set of terms that is asked for:
    (term_set, relax_tier, component, diagnostic, reparation_cost, copies).

    Requests meet the sets by ``request_term_sets``, so the rows of a set come once however many
    requests ask for it. Equal rows of the price list come once, with their number. ``min_word`` adds the
    second rung for sets without a match, ``rarest`` the way it is answered (see ``repair_estimate``).
    """
    _, answers, rows = _lookup(requests, catalog, request_id, min_word, rarest)
    return keyed_join(rows, materialize(answers), ["_signature"]).select(_set_name(), "relax_tier", *_ROW, "copies")


def repair_estimate(
    requests: DataFrame,
    catalog: DataFrame,
    request_id: str = "request_id",
    min_word: int | None = 4,
    list_rows: int | None = None,
    rarest: bool = False,
) -> DataFrame:
    """Total cost and number of rows for every request, with its term set.

    Requests whose terms match nothing try the words of ``min_word`` letters and more of
    their terms (``relax_tier`` 1; ``None`` switches that off). A row with any of the words answers; with ``rarest``
    only, for each term, the rows whose words of it weigh most together, where a word weighs more the fewer rows of the price list
    hold it: the commonest words of a defect are given up first. No match gives a null total.
    The rows themselves are those of ``match_repairs`` for the term set. With ``list_rows`` the first so many
    of them, in (component, diagnostic, cost) order, are listed in the cell ``identified_repairs`` as
    well, and ``truncated`` tells whether there are more.
    """
    needs, answers, rows = _lookup(requests, catalog, request_id, min_word, rarest)
    answers = materialize(answers)
    cost = F.coalesce("reparation_cost", F.lit(0)).cast("double") * F.col("copies")
    per_signature = rows.groupBy("_signature").agg(F.sum(cost).alias("cost"), F.sum("copies").alias("n"))
    found = (
        keyed_join(answers, materialize(per_signature), ["_signature"]).groupBy("_terms", "relax_tier")
        .agg(F.sum("cost").alias("total_estimated_cost"), F.sum("n").alias("num_repairs"))
    )
    listed = []
    if list_rows is not None:
        found = found.join(_first_rows(answers, rows, list_rows), "_terms")
        listed = ["identified_repairs", (F.col("num_repairs") > F.size("identified_repairs")).alias("truncated")]
    return keyed_join(needs, materialize(found), ["_terms"], "left").select(
        request_id,
        _set_name(),
        "relax_tier",
        "total_estimated_cost",
        F.coalesce("num_repairs", F.lit(0).cast("long")).alias("num_repairs"),
        *listed,
    )


def _first_rows(answers: DataFrame, rows: DataFrame, list_rows: int) -> DataFrame:
    """(_terms, identified_repairs): the first rows of every term set, copies one by one."""
    first_of = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(*_ROW))
    times = F.least("copies", F.lit(list_rows).cast("long"))
    first = (
        rows.withColumn("_nth", first_of("_signature")).filter(F.col("_nth") <= list_rows)
        .select("_signature", *_ROW, F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("_copy"))
        .drop("_copy")
    )
    return (
        keyed_join(answers, materialize(first), ["_signature"])
        .withColumn("_nth", first_of("_terms")).filter(F.col("_nth") <= list_rows)
        .groupBy("_terms").agg(F.array_sort(F.collect_list(F.struct(*_ROW))).alias("identified_repairs"))
    )
