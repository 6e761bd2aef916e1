"""Chemical classes of compound names, and tests of classes and sets."""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from histomill.errors import InvalidParameterError, require_column
from histomill.functions import special
from histomill.functions.ranks import with_bh
from histomill.model import Cohort
from histomill.operators.difference import rank_table, with_rank_p
from histomill.storage import stored

# The classes, in reporting order.
CHEMICAL_CLASSES = (
    "Glycerophospholipid",
    "Sphingolipid",
    "Glycerolipid",
    "Sterol",
    "Fatty acyl",
    "Amino acid",
    "Peptide",
    "Nucleotide",
    "Polyamine",
    "Carbohydrate",
    "Organic acid",
    "Vitamin/cofactor",
    "Amine",
    "Alkaloid",
    "Xenobiotic",
    "Unclassified",
)

# Whole names by class.
NAMES = {
    "Amino acid": (
        "glycine", "alanine", "serine", "threonine", "cysteine", "valine", "leucine", "isoleucine", "methionine", "proline", "phenylalanine",
        "tyrosine", "tryptophan", "aspartic acid", "glutamic acid", "asparagine", "glutamine", "lysine", "arginine", "histidine", "ornithine",
        "citrulline", "taurine", "sarcosine", "betaine", "hydroxyproline", "homocysteine", "homoserine", "cystathionine", "theanine",
    ),
    "Peptide": (
        "glutathione", "oxidized glutathione", "glutathione disulfide", "carnosine", "homocarnosine", "anserine", "ophthalmic acid",
    ),
    "Polyamine": (
        "putrescine", "cadaverine", "spermidine", "spermine", "agmatine", "n1-acetylspermidine", "n1-acetylspermine", "n8-acetylspermidine",
        "1-methylspermidine", "canavalmine", "thermospermine",
    ),
    "Amine": (
        "carnitine", "acetylcarnitine", "choline", "phosphocholine", "glycerophosphocholine", "ethanolamine", "o-phosphoethanolamine",
        "phosphoethanolamine", "sphingosine", "sphinganine", "phytosphingosine",
    ),
    "Sterol": (
        "cholesterol", "cholesteryl ester", "cholic acid", "deoxycholic acid", "chenodeoxycholic acid", "taurocholic acid", "glycocholic acid",
        "lithocholic acid", "cortisol", "cortisone", "testosterone", "estradiol", "progesterone", "pregnenolone", "dehydroepiandrosterone",
        "lanosterol", "desmosterol", "7-dehydrocholesterol",
    ),
    "Organic acid": (
        "citric acid", "citrate", "lactic acid", "lactate", "pyruvic acid", "pyruvate", "succinic acid", "succinate", "fumaric acid", "fumarate",
        "malic acid", "malate", "oxaloacetic acid", "alpha-ketoglutaric acid", "2-oxoglutaric acid", "isocitric acid", "aconitic acid",
        "acetoacetic acid", "beta-hydroxybutyric acid", "urocanic acid",
    ),
    "Nucleotide": (
        "atp", "adp", "amp", "gtp", "gdp", "gmp", "utp", "udp", "ump", "ctp", "cdp", "cmp", "nad", "nadh", "nadp", "nadph", "fad", "fadh2",
        "adenine", "adenosine", "guanine", "guanosine", "cytosine", "cytidine", "thymine", "thymidine", "uracil", "uridine", "inosine",
        "hypoxanthine", "xanthine", "coenzyme a", "acetyl-coa",
    ),
    "Carbohydrate": (
        "glucose", "fructose", "galactose", "mannose", "sucrose", "lactose", "maltose", "ribose", "glucose-6-phosphate", "fructose-6-phosphate",
        "glucosamine", "n-acetylglucosamine", "n-acetylneuraminic acid", "sorbitol", "mannitol", "inositol", "myo-inositol", "glycogen", "trehalose",
    ),
    "Vitamin/cofactor": (
        "ascorbic acid", "retinol", "retinoic acid", "thiamine", "riboflavin", "niacin", "nicotinamide", "nicotinic acid", "pantothenic acid",
        "pyridoxine", "pyridoxal", "biotin", "folic acid", "cobalamin", "tocopherol", "alpha-tocopherol", "phylloquinone", "menaquinone", "heme",
        "biliverdin", "bilirubin",
    ),
}

# Class of every head of lipid shorthand.
LIPID_HEADS = {
    "pc": "Glycerophospholipid", "pe": "Glycerophospholipid", "ps": "Glycerophospholipid", "pi": "Glycerophospholipid", "pg": "Glycerophospholipid",
    "pa": "Glycerophospholipid", "lpc": "Glycerophospholipid", "lpe": "Glycerophospholipid", "lps": "Glycerophospholipid",
    "lpi": "Glycerophospholipid", "lpg": "Glycerophospholipid", "lpa": "Glycerophospholipid", "plasmenyl-pc": "Glycerophospholipid",
    "plasmenyl-pe": "Glycerophospholipid", "cl": "Glycerophospholipid", "bmp": "Glycerophospholipid",
    "sm": "Sphingolipid", "cer": "Sphingolipid", "hexcer": "Sphingolipid", "glccer": "Sphingolipid", "galcer": "Sphingolipid",
    "laccer": "Sphingolipid", "s1p": "Sphingolipid", "so": "Sphingolipid", "sph": "Sphingolipid", "gb3": "Sphingolipid", "gm1": "Sphingolipid",
    "gm3": "Sphingolipid",
    "tg": "Glycerolipid", "dg": "Glycerolipid", "mg": "Glycerolipid", "tag": "Glycerolipid", "dag": "Glycerolipid", "mag": "Glycerolipid",
    "ce": "Sterol", "st": "Sterol",
    "fa": "Fatty acyl", "car": "Fatty acyl", "acylcarnitine": "Fatty acyl", "coa": "Fatty acyl", "wax": "Fatty acyl",
}

# Patterns in the order in which they are tried; case is ignored.
PATTERNS = [
    ("Glycerophospholipid", r"phosphatidylcholine|phosphatidylethanolamine|phosphatidylserine|phosphatidylinositol|phosphatidylglycerol|phosphatidic acid|lysophosphatid|cardiolipin|plasmalogen"),
    ("Sphingolipid", r"sphingomyelin|ceramide|sphingosine|sphinganine|sphingoid|cerebroside|ganglioside|sulfatide"),
    ("Glycerolipid", r"triacylglycerol|diacylglycerol|monoacylglycerol|triglyceride|diglyceride|monoglyceride"),
    ("Sterol", r"cholest|sterol|steroid|bile acid|cholan|androst|estr[ao]|pregn|lanost|cucurbitacin|withanolid|ecdyson"),
    ("Fatty acyl", r"carnitine|acyl-coa|fatty acid|\benoic acid\b|anoic acid|prostaglandin|leukotriene|thromboxane|eicosanoid"),
    ("Polyamine", r"spermidine|spermine|putrescine|cadaverine|agmatine|polyamine"),
    ("Nucleotide", r"adenosine|guanosine|cytidine|thymidine|uridine|inosine|nucleotide|nucleoside|purine|pyrimidine|\bdeoxy.*(sine|dine)\b"),
    ("Carbohydrate", r"glucos|fructos|galactos|mannos|sucros|lactos|maltos|ribos|saccharide|hexose|pentose|glycan|inositol|sorbitol|mannitol"),
    ("Vitamin/cofactor", r"vitamin|tocopherol|retino|thiamin|riboflavin|niacin|folate|folic|cobalamin|biotin|pantothen|pyridox|quinone|porphyrin|heme"),
    (
        "Peptide",
        r"(glycyl|alanyl|seryl|threonyl|cysteinyl|valyl|leucyl|isoleucyl|methionyl|prolyl|phenylalanyl|tyrosyl|tryptophyl|aspartyl|glutamyl|asparaginyl|glutaminyl|lysyl|arginyl|histidyl)",
    ),
    ("Amino acid", r"^(l|d|dl)-\w+|amino acid|amino.*butyric acid"),
    ("Amine", r"\bamine\b|piperidin|piperazin|pyrrolidin|morpholin|imidazol|hydrazin|anilin|amino"),
    (
        "Alkaloid",
        r"alkaloid|quinolin|isoquinolin|indol|carbolin|tropan|berberin|morphin|codein|nicotin|caffein|xanthin|pyrrol|piperin|vinca|strychn|atropin|quinin|ergot|harman",
    ),
    ("Organic acid", r"acid$|oate$|\bcarboxyl"),
]

# Suffixes in the order in which they are tried.
SUFFIXES = [
    ("carnitine", "Fatty acyl"),
    ("choline", "Amine"),
    ("ethanolamine", "Amine"),
    ("phosphate", "Organic acid"),
    ("sulfate", "Organic acid"),
    ("nitrile", "Xenobiotic"),
    ("urea", "Xenobiotic"),
    ("carbamate", "Xenobiotic"),
    ("ol", "Amine"),
]

# What is peeled off the front of a name, and the form of lipid shorthand.
DESCRIPTOR = r"^\s*(\((?:[+\-±]|[0-9]*[a-z]?[RSEZ](?:,\s*[0-9]*[a-z]?[RSEZ])*|[0-9]+[a-z]*(?:alpha|beta)?(?:,\s*[0-9]+[a-z]*(?:alpha|beta)?)*)\)|[+\-±])[-\s]*"
PREFIXES = [r"^(l|d|dl)[-\s]", r"^(n[0-9]?|o|s)[-\s]?(acetyl|methyl|formyl)[-\s]?"]
SHORTHAND = r"^([A-Za-z][A-Za-z0-9\-]{0,9})\s*[\(\[]\s*[dtoOP]?\d+:\d+"

#: Share of unclassified compounds above which a warning is given.
MANY = 0.25


class Rules:
    """The rule tables, compiled."""

    def __init__(self) -> None:
        self.whole = {n: c for c, names in NAMES.items() for n in names}
        self.patterns = [(c, re.compile(p, re.I)) for c, p in PATTERNS]
        self.descriptor, self.shorthand = re.compile(DESCRIPTOR, re.I), re.compile(SHORTHAND, re.I)
        self.prefixes = [re.compile(p) for p in PREFIXES]

    def core(self, name: str) -> str:
        """The name less up to four descriptors in front."""
        name = name.strip()
        for _ in range(4):
            name = self.descriptor.sub("", name, 1)
        return name

    def __call__(self, name: str) -> str:
        core = self.core(name)
        bare = plain = core.lower()
        for p in self.prefixes:
            bare = p.sub("", bare)
        shorthand = self.shorthand.match(core)
        tries = (
            self.whole.get(plain),
            self.whole.get(bare),
            LIPID_HEADS.get(shorthand[1].lower()) if shorthand else None,
            next((c for c, p in self.patterns if p.search(plain)), None),
            next((c for s, c in SUFFIXES if plain.endswith(s)), None),
        )
        return next(filter(None, tries), CHEMICAL_CLASSES[-1])


@F.pandas_udf(StringType())
def rule_class(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Class of every name by the rules; null for null."""
    rules = Rules()
    for s in names:
        yield s.map(lambda n: None if n is None else rules(n))


def classify_names(features: DataFrame, reference: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """``features`` with ``chemical_class``: an override (``metabolite, chemical_class``), else the
    reference's, else the rules'. Names are compared without case."""
    folded = lambda t, c: t.groupBy(F.lower(F.trim("metabolite")).alias("_name")).agg(F.max("chemical_class").alias(c))
    out = features.withColumn("_name", F.lower(F.trim("metabolite")))
    given = []
    for table, column in ((overrides, "_o"), (reference, "_r")):
        if table is not None:
            out = out.join(folded(table, column), "_name", "left")
            given.append(F.col(column))
    return out.withColumn("chemical_class", F.coalesce(*given, rule_class("metabolite"))).drop("_name", "_o", "_r")


def classify_compounds(cohort: Cohort, reference: Mapping[str, str] | None = None, overrides: Mapping[str, str] | None = None) -> Cohort:
    """The cohort with ``chemical_class`` about its features."""
    spark = cohort.pixels.sparkSession
    table = lambda m: spark.createDataFrame(list(m.items()), "metabolite string, chemical_class string") if m else None
    rows = classify_names(cohort.features().select("feature_idx", "metabolite"), table(reference), table(overrides)).orderBy("feature_idx").collect()
    labels = [r.chemical_class for r in rows]
    unknown = labels.count(CHEMICAL_CLASSES[-1]) / max(1, len(labels))
    if unknown > MANY:
        warnings.warn(f"{unknown:.0%} of the compounds have no class; a reference table helps.", stacklevel=2)
    return cohort.describe_features("chemical_class", labels).record("classify_compounds", {"n": len(labels)})


def classification_report(features: DataFrame) -> DataFrame:
    """``chemical_class, n_compounds, fraction``."""
    require_column(features.columns, "chemical_class")
    counts = features.groupBy("chemical_class").agg(F.count(F.lit(1)).alias("n_compounds"))
    share = F.col("n_compounds") / F.sum("n_compounds").over(Window.partitionBy())  # a row a class
    return counts.withColumn("fraction", share).orderBy(F.desc("n_compounds"), "chemical_class")


def class_enrichment(result: DataFrame, classes: DataFrame, effect_col: str = "delta", min_size: int = 3) -> DataFrame:
    """Effects of each class against all other compounds, the unclassified ones included."""
    require_column(result.columns, effect_col)
    rows = result.select("metabolite", F.col(effect_col).cast("double").alias("value")).join(classes.select("metabolite", "chemical_class"), "metabolite")
    rows = rows.where("value IS NOT NULL AND chemical_class IS NOT NULL")
    summary = rows.where(F.col("chemical_class") != CHEMICAL_CLASSES[-1]).groupBy("chemical_class").agg(
        F.count(F.lit(1)).alias("n_compounds"),
        F.median("value").alias("median_delta"),
        F.avg(F.abs("value")).alias("mean_abs_delta"),
        F.count_if(F.col("value") > 0).alias("n_up"),
        F.count_if(F.col("value") < 0).alias("n_down"),
    ).where(F.col("n_compounds") >= min_size)
    # at most 15 classes beside every compound
    inside = F.when(F.col("rows.chemical_class") == F.col("k.c"), 1).otherwise(2)
    every = rows.alias("rows").crossJoin(F.broadcast(summary.select(F.col("chemical_class").alias("c")).alias("k")))
    tested = with_rank_p(rank_table(every.select("c", "value", inside.alias("grp")), "c"))
    return with_bh(summary.join(tested.select(F.col("c").alias("chemical_class"), "pval"), "chemical_class")).orderBy(F.desc(F.abs("median_delta")), "chemical_class")


def set_rows(spark, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """``set_name, member`` of a mapping."""
    return spark.createDataFrame([(n, str(m)) for n, members in sets.items() for m in members], "set_name string, member string")


def pathway_ora(
    result: DataFrame, sets: DataFrame, effect_col: str = "delta", delta_threshold: float = 0.474, fdr_threshold: float | None = None, direction: bool = True, min_size: int = 3
) -> DataFrame:
    """Fisher's exact test of ``sets(set_name, member)`` against the measured compounds."""
    require_column(result.columns, effect_col)
    if fdr_threshold is not None:
        require_column(result.columns, "pval_adj")
    moved = F.abs(effect_col) >= delta_threshold
    moved = moved & (F.col("pval_adj") < fdr_threshold) if fdr_threshold is not None else moved
    rows = result.select("metabolite", F.lower(F.trim("metabolite")).alias("name"), F.col(effect_col).alias("e"), F.coalesce(moved, F.lit(False)).alias("moved"))
    ways = [("any", F.col("moved"))] + ([("up", F.col("moved") & (F.col("e") > 0)), ("down", F.col("moved") & (F.col("e") < 0))] if direction else [])
    per = F.explode(F.array(*[F.struct(F.lit(n).alias("direction"), c.alias("hit")) for n, c in ways]))
    marked = rows.select("metabolite", "name", per.alias("d")).select("metabolite", "name", "d.direction", "d.hit")
    totals = marked.groupBy("direction").agg(
        F.count_if("hit").alias("n_shifted"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("name").alias("n_background")
    )
    members = sets.select("set_name", F.lower(F.trim("member")).alias("name")).distinct()
    inside = members.join(marked, "name").groupBy(F.col("set_name").alias("pathway"), "direction").agg(
        F.countDistinct("name").alias("n_in_set"), F.count(F.lit(1)).alias("n_inside"), F.count_if("hit").alias("n_hits"),
        F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("metabolite")))).alias("h"),
    )
    table = inside.where((F.col("n_in_set") >= min_size) & (F.col("n_hits") > 0)).join(totals, "direction")
    a, b = F.col("n_hits"), F.col("n_inside") - F.col("n_hits")
    c = F.col("n_shifted") - F.col("n_hits")
    d = F.col("n_rows") - F.col("n_inside") - c
    odds = F.when(b * c == 0, F.lit(float("inf"))).otherwise(F.try_divide(a * d, b * c))
    p = special.fisher_greater_udf("n_hits", "n_inside", "n_shifted", "n_rows")
    tested = with_bh(table.withColumn("odds_ratio", odds).withColumn("pval", p), "pval", "pval_adj", "direction")
    return tested.select(
        "pathway", "direction", "n_in_set", "n_hits", "n_shifted", "n_background", "odds_ratio", "pval", "pval_adj", F.array_join(F.slice("h", 1, 10), ", ").alias("hits")
    ).orderBy("direction", "pval", "pathway")


def enrichment_scores(result: DataFrame, sets: DataFrame, score_col: str = "delta", min_set_size: int = 3) -> DataFrame:
    """``pathway, n_metabolites, n_found, es, leading_edge``: the running sum over compounds in
    order of score (ties by name), hits stepping up by their share of the set's absolute score,
    misses down evenly."""
    ranked = result.select("metabolite", F.col(score_col).cast("double").alias("s")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), "metabolite")))  # a panel
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = ranked.withColumn("n", n)
    sizes = sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_metabolites"))
    hits = sets.distinct().join(ranked, sets.member == ranked.metabolite).select("set_name", "metabolite", "s", "r", "n")
    own = Window.partitionBy("set_name")
    order = own.orderBy("r")
    hits = hits.withColumn("n_found", F.count(F.lit(1)).over(own)).where(F.col("n_found") >= min_set_size)
    up = F.sum(F.abs("s")).over(order) / (F.sum(F.abs("s")).over(own) + 1e-12)
    k = F.row_number().over(order)
    miss = F.greatest(F.col("n") - F.col("n_found"), F.lit(1))
    # the sum peaks at a hit and bottoms just before one, or at the end
    walk = hits.withColumn("top", up - (F.col("r") - k) / miss).withColumn("low", F.lag(up, 1, 0.0).over(order) - (F.col("r") - k) / miss)
    ends = walk.groupBy("set_name").agg(
        F.max("n_found").alias("n_found"), F.max("top").alias("hi"), F.max_by("r", F.struct("top", -F.col("r"))).alias("r_hi"), F.min("low").alias("lo"),
        F.min_by("r", F.struct("low", "r")).alias("r_lo"), F.array_sort(F.collect_list(F.struct("r", "metabolite"))).alias("m"),
    )
    es = F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    edge = F.filter("m", lambda x: F.when(F.col("es") > 0, x["r"] <= F.col("r_hi")).otherwise(x["r"] >= F.col("r_lo")))
    return ends.withColumn("es", es).join(sizes, "set_name").select(
        F.col("set_name").alias("pathway"), "n_metabolites", "n_found", "es", F.array_join(F.transform(F.slice(edge, 1, 10), lambda x: x["metabolite"]), ", ").alias("leading_edge")
    )


def _null_walks(scores: np.ndarray, k: int, first: int, count: int, seed: int) -> list[float]:
    """Enrichment scores of permutations ``first`` to ``first + count`` of sets of ``k`` among
    ``scores``, which are in order. Draws are numbered through, so a permutation is the same whoever
    makes it; only one is held at a time, and its walk is followed from hit to hit."""
    size, out = len(scores), []
    weights, misses = np.abs(scores), max(len(scores) - k, 1)
    rng = np.random.default_rng([seed, k])
    rng.bit_generator.advance(first * size)
    few = (k + 6 * math.sqrt(k) + 6) / size  # nearly always, k draws are below it
    for _ in range(count):
        u = rng.random(size)
        near = np.flatnonzero(u < few)
        near = near if len(near) >= k else np.arange(size)
        drawn = u[near]
        hits = near[drawn <= np.partition(drawn, k - 1)[k - 1]][:k]
        up = np.concatenate([[0.0], weights[hits].cumsum()])
        up /= up[-1] + 1e-12
        down = (hits - np.arange(k)) / misses
        high, low = (up[1:] - down).max(), min((up[:-1] - down).min(), up[-1] - (size - k) / misses)
        out.append(float(high if high >= -low else low))
    return out


#: Draws of a task's step in the permutations of set enrichment.
STEP_DRAWS = 4_000_000


def metabolite_set_enrichment(result: DataFrame, sets: DataFrame, score_col: str = "delta", min_set_size: int = 3, n_permutations: int = 1000, random_state: int = 0) -> DataFrame:
    """Enrichment scores with permuted nulls: the panel's scores are shipped once, permutations of
    every size of set are dealt to tasks in steps, and draws come from the size and the permutation's
    number, so tasks do not matter. Null scores stand last and weigh nothing."""
    observed = stored(enrichment_scores(result, sets, score_col, min_set_size), "enrichment")
    column = result.select(F.col(score_col).cast("double").alias("s")).toArrow()["s"]  # 8 bytes a compound
    known = np.sort(column.drop_null().to_numpy())[::-1]
    scores = np.concatenate([known, np.zeros(column.null_count)])
    step = max(1, min(n_permutations, STEP_DRAWS // max(1, len(scores))))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, first in zip(b["n_found"], b["first"], strict=True):
                yield pd.DataFrame({"n_found": [k], "first": [first], "drawn": [_null_walks(scores, int(k), int(first), min(step, n_permutations - int(first)), random_state)]})

    def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nes, p = [], []
            for es, drawn in zip(b["es"], b["drawn"], strict=True):
                drawn = np.asarray(drawn, float)
                same = drawn[drawn >= 0] if es >= 0 else -drawn[drawn < 0]
                nes.append(es / ((same.mean() if len(same) else 0) + 1e-12))
                p.append(((same >= abs(es)).sum() + 1) / (len(same) + 1))
            yield b.drop(columns="drawn").assign(nes=nes, pval=p)

    steps = F.sequence(F.lit(0), F.lit(n_permutations - 1), F.lit(step)) if n_permutations > 0 else F.array().cast("array<int>")
    tasks = 4 * result.sparkSession.sparkContext.defaultParallelism
    jobs = observed.select("n_found").distinct().withColumn("first", F.explode(steps)).repartition(tasks, "n_found", "first")
    parts = jobs.mapInPandas(draw, "n_found long, first int, drawn array<double>")
    # n_permutations numbers for every size of set
    nulls = parts.groupBy("n_found").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "drawn"))), lambda r: r["drawn"])).alias("drawn"))
    both = observed.join(nulls, "n_found", "left").select(*observed.columns, F.coalesce("drawn", F.array().cast("array<double>")).alias("drawn"))
    scored = both.mapInPandas(against, "pathway string, n_metabolites long, n_found long, es double, leading_edge string, nes double, pval double")
    return with_bh(scored).select("pathway", "n_metabolites", "n_found", "es", "nes", "pval", "pval_adj", "leading_edge").orderBy(F.desc("nes"), "pathway")


def annotate_pathways(result: DataFrame, identifiers: DataFrame, links: DataFrame, names: DataFrame, min_size: int = 3, **options) -> DataFrame:
    """Over-representation of pathways: compounds by ``identifiers(query, kegg)``, pathways by
    ``links(compound, pathway)`` and ``names(pathway, name)``."""
    known = identifiers.where("kegg IS NOT NULL")
    if known.join(result.select(F.col("metabolite").alias("query")), "query", "left_semi").isEmpty():
        raise InvalidParameterError("No compound has an identifier.")
    members = known.join(links, F.upper("kegg") == F.upper("compound")).join(names, "pathway", "left")
    sets = members.select(F.coalesce("name", "pathway").alias("set_name"), F.col("query").alias("member")).distinct()
    return pathway_ora(result, sets, min_size=min_size, **options)
