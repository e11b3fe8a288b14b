"""Entity resolution: pairs and clusters of candidates that name one thing, by deterministic signals.

candidates(pos, slug, title, aliases) and, for the abbreviation signal, a corpus(text). Each signal is a self join on a
blocking key that every true pair shares (a canonical form, a token, a prefix, a number); none compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.registry import query
from folioforge.sources.tables import table

#: Signals in rank order; the first that joins a pair names it.
RANK = ("transliteration", "alias", "abbreviation", "edit-distance", "indicator-form", "subsequence", "initials", "glossary")
AUTO = ("transliteration", "alias")
#: Words that make an extra token a unit of its own instead of a longer name of the same thing.
UNIT_WORDS = "auditorium afdeling afdelingen afsnit department ward klinik klinikken clinic ambulatorium ambulatoriet hospital hospitaler sygehus sygehuse institut institute institution center centre universitet university skole school laboratorium laboratory lab sektion section unit enhed team selskab company division".split()


def _sides(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = c.select("pos", "slug", "title")
    return tuple(base.select(*[F.col(x).alias(f"{side}_{x}") for x in base.columns]) for side in "ab")


def _pairs(blocked: DataFrame) -> DataFrame:
    """blocked(key, pos, slug, ...) to rows a, b with a before b in a common block."""
    a = blocked.select(F.col("key"), *[F.col(x).alias(f"a_{x}") for x in blocked.columns if x != "key"])
    b = blocked.select(F.col("key"), *[F.col(x).alias(f"b_{x}") for x in blocked.columns if x != "key"])
    return a.join(b.hint("merge"), "key").where((F.col("a_pos") < F.col("b_pos")) & (F.col("a_slug") != F.col("b_slug"))).drop("key").dropDuplicates(["a_pos", "b_pos"])


def _edges(pairs: DataFrame, into: Column, signal: str) -> DataFrame:
    """Rows (from, into, signal, a_pos, b_pos); ``into`` is one of the two slugs, null drops the pair."""
    out = pairs.withColumn("into", into).where("into is not null")
    other = F.when(F.col("into") == F.col("a_slug"), F.col("b_slug")).otherwise(F.col("a_slug"))
    return out.select(other.alias("from"), "into", F.lit(signal).alias("signal"), "a_pos", "b_pos")


def transliteration(c: DataFrame, lang: str) -> DataFrame:
    """Equal once digraphs are collapsed; the slug that spells them out survives, else the lesser."""
    k = c.where(F.length("slug") >= 6).select(T.transliteration_canonical("slug", lang).alias("key"), "pos", "slug")
    a, b = T.carries_digraph("a_slug", lang), T.carries_digraph("b_slug", lang)
    return _edges(_pairs(k), F.when(a & ~b, F.col("a_slug")).when(b & ~a, F.col("b_slug")).otherwise(F.least("a_slug", "b_slug")), "transliteration")


def alias(c: DataFrame, lang: str) -> DataFrame:
    """One's title is an alias of the other, and the alias' slug is the one's slug; the holder of the alias survives."""
    held = c.select(F.col("pos").alias("h_pos"), F.col("slug").alias("h_slug"), F.explode("aliases").alias("al")).withColumn("key", F.lower(T.strip("al")))
    held = held.where((F.length("key") >= 2)).withColumn("al_slug", T.slugify("al", lang))
    named = c.select("pos", "slug", F.lower(T.strip("title")).alias("key"))
    m = named.join(held.hint("merge"), "key").where((F.col("slug") != F.col("h_slug")) & (F.col("al_slug") == F.col("slug")))
    return m.select(F.col("slug").alias("from"), F.col("h_slug").alias("into"), F.lit("alias").alias("signal"), F.least("pos", "h_pos").alias("a_pos"), F.greatest("pos", "h_pos").alias("b_pos")).distinct()


#: Small words that may stand inside a name.
CONNECTORS = "af and de dem den der det for i in of og the und".split()
_UPPER = "A-ZÆØÅÄÖÜ"
_WORD = rf"[{_UPPER}][{_UPPER}a-zæøåäöüé-]*"
#: One to six words, capitalised but for connectors after the first, and two to eight capitals in brackets.
INTRODUCED = rf"({_WORD}(?:\s+(?:{_WORD}|{'|'.join(CONNECTORS)})){{0,5}})\s*\(([{_UPPER}]{{2,8}})\)"

#: Terms of the domain, English and Danish.
GLOSSARY = """
anesthesia = anæstesi; anticoagulation therapy = antikoagulationsbehandling; atrial fibrillation = atrieflimren; bleeding = blødning
creatinine = kreatinin; ct scan = ct-skanning; diabetes = sukkersyge; echocardiography = ekkokardiografi; emergency department = akutafdelingen
general practitioner = almen læge; health clusters = sundhedsklynger; heart failure = hjertesvigt; hemoglobin = hæmoglobin
intracranial hemorrhage = intrakraniel blødning; ischemic stroke = iskæmisk apopleksi; major bleeding = stor blødning; mortality = mortalitet
mri scan = mr-skanning; national patient registry = landspatientregisteret; outpatient clinic = ambulatorium; patient education = patientuddannelse
quality indicator = kvalitetsindikator; quality registry = kvalitetsdatabase; readmission = genindlæggelse; rehabilitation = genoptræning
renal function = nyrefunktion; serious bleeding = alvorlig blødning; stroke = apopleksi; surgery = kirurgi
thyroid stimulating hormone = thyreoideastimulerende hormon
"""


def glossary_terms(spark: SparkSession) -> DataFrame:
    """``(group, term, slug, lang)`` of GLOSSARY, each slug by its own language's rules."""
    rows = [(i, *pair.split(" = ")) for i, pair in enumerate(p.strip() for p in GLOSSARY.replace("\n", ";").split(";") if p.strip())]
    t = spark.createDataFrame(rows, "group int, en string, da string")
    return t.select("group", F.col("en").alias("term"), T.slugify("en").alias("slug"), F.lit("en").alias("lang")).union(t.select("group", "da", T.slugify("da", "da"), F.lit("da")))


def abbreviation(c: DataFrame, corpus: DataFrame, lang: str) -> DataFrame:
    """``Full Name (ABBR)`` occurs in the corpus, both are candidates, and the letters of ABBR follow each other in the name; the name survives."""
    full, short = (F.regexp_extract_all("text", F.lit(INTRODUCED), F.lit(i)) for i in (1, 2))
    found = corpus.select(F.explode(F.arrays_zip(full.alias("full"), short.alias("short"))).alias("x")).select("x.full", "x.short").distinct()
    ok = found.where(T.letters_in_order("short", "full")).select(T.slugify("full", lang).alias("into"), T.slugify("short", lang).alias("from")).where("into <> `from` and length(`from`) >= 2").distinct()
    slugs = c.select("slug", "pos")
    m = ok.join(slugs.select(F.col("slug").alias("into"), F.col("pos").alias("p")), "into").join(slugs.select(F.col("slug").alias("from"), F.col("pos").alias("q")), "from")
    return m.select("from", "into", F.lit("abbreviation").alias("signal"), F.least("p", "q").alias("a_pos"), F.greatest("p", "q").alias("b_pos"))


#: Tails up to this length meet by what is left of them without letters, longer ones by thirds.
SHORT_TAIL = 16


def _digitless(c: str) -> Column:
    return F.regexp_replace(c, r"\d", "")


def _without(t: Column, n: int) -> Column:
    """All that ``t`` becomes without ``n`` of its letters, 0 to 2."""
    cut = lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1))
    if n == 0:
        return F.array(t)
    if n == 1:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t)), cut))
    two = lambda i: F.transform(F.sequence(i + 1, F.length(t)), lambda j: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1, j - i - 1), F.substr(t, j + 1)))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(t) - 1), two)))


def _tagged(k: Column | int, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct((F.lit(k) if isinstance(k, int) else k).alias("k"), v.alias("v")))


def _thirds(tail: Column, l: Column, shifts: tuple[int, ...]) -> Column:  # noqa: E741
    """The thirds of a tail of a slug of ``l`` letters, where they stand or shifted."""
    m = F.floor(F.floor(l / 2) / 3).cast("int")
    size = lambda i: m if i < 2 else F.floor(l / 2).cast("int") - m * 2
    at = lambda i, s: F.when(m * i + 1 + s >= 1, F.concat(F.lit(f"{i}:"), F.substr(tail, m * i + 1 + s, size(i))))
    return F.filter(F.array(*[at(i, s) for i in range(3) for s in shifts]), lambda v: v.isNotNull())


def _shorter_tails(tail: str, l: str) -> Column:  # noqa: E741
    """What a tail has in common with each one of 0, 1 or 2 letters more (k) within two edits.

    Of equal lengths both are the same without some two letters; one letter longer, this without one and that without two;
    two longer, that without two is this. Of three thirds of a longer tail two edits leave one as it is, shifted by -1 to 2.
    """
    t, l = F.col(tail), F.col(l)  # noqa: E741
    return F.when(F.floor(l / 2) <= SHORT_TAIL, F.concat(*[_tagged(k, _without(t, 2 - k)) for k in range(3)])).otherwise(_tagged(9, _thirds(t, l, (0,))))


def _longer_tails(tail: str, l: str, k: str) -> Column:  # noqa: E741
    """The other side of ``_shorter_tails``."""
    t, l = F.col(tail), F.col(l)  # noqa: E741
    return F.when(F.floor(l / 2) <= SHORT_TAIL, _tagged(F.col(k), _without(t, 2))).otherwise(_tagged(9, F.array_distinct(_thirds(t, l, (-1, 0, 1, 2)))))


def edit_distance(c: DataFrame) -> DataFrame:
    """One or two edits between slugs of ten letters or more that agree in at least half their letters from the start and
    don't differ in digits only; the longer survives, the earlier at equal length."""
    base = c.where(F.length("slug") >= 10).select("pos", "slug", F.length("slug").alias("n"))
    # blocks are (length of the shorter, its first half); what differs in digits only is no pair, so that a block of numbered
    # names of one kind has none
    keyed = base.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).withColumn("l", F.col("n") - F.col("k")).where("l >= 10")
    half = F.ceil(F.col("l") / 2).cast("int")
    keyed = keyed.withColumn("head", F.substr("slug", F.lit(1), half)).withColumn("tail", F.substr("slug", half + 1))
    kinds = keyed.groupBy("l", "head").agg(F.min(_digitless("slug")).alias("lo"), F.max(_digitless("slug")).alias("hi")).where("lo <> hi")
    keyed = keyed.join(kinds.select("l", "head").hint("merge"), ["l", "head"], "left_semi")
    key = lambda v: F.xxhash64("l", "head", v["k"], v["v"]).alias("key")
    a = keyed.where("k = 0").withColumn("v", F.explode(_shorter_tails("tail", "l"))).select(key(F.col("v")), F.col("pos").alias("x_pos"), F.col("slug").alias("x"))
    b = keyed.withColumn("v", F.explode(_longer_tails("tail", "l", "k"))).select(key(F.col("v")), F.col("pos").alias("y_pos"), F.col("slug").alias("y"))
    # no broadcast: the keys of a slug take more room than files and shuffles of slugs show
    p = a.join(b.hint("merge"), "key").where("x <> y").withColumn("l", F.length("x")).withColumn("yn", F.length("y"))
    p = p.where((F.col("yn") > F.col("l")) | ((F.col("yn") == F.col("l")) & (F.col("x_pos") < F.col("y_pos")))).where(F.substr("x", F.lit(1), half) == F.substr("y", F.lit(1), half))
    p = p.where(F.levenshtein("x", "y", 2).between(1, 2)).where(_digitless("x") != _digitless("y")).dropDuplicates(["x_pos", "x", "y_pos", "y"])
    into = F.when(F.col("yn") > F.col("l"), F.col("y")).otherwise(F.col("x"))
    other = F.when(F.col("yn") > F.col("l"), F.col("x")).otherwise(F.col("y"))
    return p.select(other.alias("from"), into.alias("into"), F.lit("edit-distance").alias("signal"), F.least("x_pos", "y_pos").alias("a_pos"), F.greatest("x_pos", "y_pos").alias("b_pos"))


def indicator_form(c: DataFrame) -> DataFrame:
    """Indicators of one number: a bare one survives a named one; of two alike the lesser; different names never match."""
    k = c.withColumn("i", T.indicator("slug")).where("i is not null").select(F.col("i.number").alias("key"), "pos", "slug", F.col("i.name").alias("name"))
    a, b = F.col("a_name"), F.col("b_name")
    into = F.when(a.isNull() & b.isNotNull(), F.col("a_slug")).when(b.isNull() & a.isNotNull(), F.col("b_slug")).when(a.eqNullSafe(b), F.least("a_slug", "b_slug"))
    return _edges(_pairs(k), into, "indicator-form")


def subsequence(c: DataFrame) -> DataFrame:
    """All tokens of the shorter (two or more) occur in order in the longer, and no extra is a unit word or a number; the shorter survives."""
    tok = c.withColumn("t", F.split("slug", "-")).where(F.size("t") >= 2)
    # blocks are two tokens, the first two of the shorter in their order, as one common word ("hospital") makes large ones
    short = tok.select(F.concat_ws("-", F.get("t", F.lit(0)), F.get("t", F.lit(1))).alias("key"), F.col("pos").alias("s_pos"), F.col("slug").alias("s_slug"), F.col("t").alias("s_t"))
    two = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.concat_ws("-", x, y))))
    long = tok.where(F.size("t") >= 3).select(F.explode(F.array_distinct(two)).alias("key"), F.col("pos").alias("l_pos"), F.col("slug").alias("l_slug"), F.col("t").alias("l_t"))
    p = short.join(long.hint("merge"), "key").where((F.col("s_slug") != F.col("l_slug")) & (F.size("s_t") < F.size("l_t")))
    state = F.aggregate("l_t", F.struct(F.lit(0).alias("i"), F.array().cast("array<string>").alias("extra")), lambda s, x: F.when(F.get(F.col("s_t"), s["i"]) == x, F.struct((s["i"] + 1).alias("i"), s["extra"].alias("extra"))).otherwise(F.struct(s["i"].alias("i"), F.concat(s["extra"], F.array(x)).alias("extra"))))
    p = p.withColumn("r", state).where((F.col("r.i") == F.size("s_t")) & ~F.exists("r.extra", lambda x: x.isin(*UNIT_WORDS) | x.rlike(r"^\d+$")))
    return p.select(F.col("l_slug").alias("from"), F.col("s_slug").alias("into"), F.lit("subsequence").alias("signal"), F.least("s_pos", "l_pos").alias("a_pos"), F.greatest("s_pos", "l_pos").alias("b_pos"))


def initials(c: DataFrame, lang: str) -> DataFrame:
    """A token of three letters or more in common; every other token is an initial or begins with an initial of the other
    side, in any order, and at least one is spelled out; the slug of fewer tokens survives, the earlier at equal number."""
    tok = c.withColumn("t", F.split(T.transliteration_canonical("slug", lang), "-"))
    initial = lambda u: u.rlike("^[a-z]$")
    # blocks are a common token and the letter of an initial on one side, of a word on the other: only slugs with initials
    # meet, and what shares a common word alone doesn't
    k = tok.select(F.explode(F.array_distinct(F.filter("t", lambda x: F.length(x) >= 3))).alias("key"), "pos", "slug", "t")
    side = lambda s, keep: k.select("key", F.explode(F.array_distinct(F.transform(F.filter("t", keep), lambda u: F.substring(u, 1, 1)))).alias("c"), *[F.col(x).alias(f"{s}_{x}") for x in ("pos", "slug", "t")])
    met = side("x", initial).join(side("y", lambda u: ~initial(u)).hint("merge"), ["key", "c"]).where((F.col("x_pos") != F.col("y_pos")) & (F.col("x_slug") != F.col("y_slug")))
    first = F.col("x_pos") < F.col("y_pos")
    at = lambda f, x: F.when(first == f, F.col(f"x_{x}")).otherwise(F.col(f"y_{x}"))
    p = met.select(*[at(F.lit(s == "a"), x).alias(f"{s}_{x}") for s in "ab" for x in ("pos", "slug", "t")]).dropDuplicates(["a_pos", "b_pos"])
    rest = lambda x, y: F.filter(x, lambda u: (F.length(u) < 3) | ~F.array_contains(y, u))
    p = p.withColumn("a_r", rest("a_t", F.col("b_t"))).withColumn("b_r", rest("b_t", F.col("a_t")))
    p = p.withColumn("a_i", F.filter("a_r", initial)).withColumn("b_i", F.filter("b_r", initial))
    meets = lambda u, i: F.array_contains(F.col(i), F.substring(u, 1, 1))
    aligned = lambda r, i: F.forall(r, lambda u: initial(u) | meets(u, i))
    spelled = lambda r, i: F.exists(r, lambda u: ~initial(u) & meets(u, i))
    p = p.where(aligned("a_r", "b_i") & aligned("b_r", "a_i") & (spelled("a_r", "b_i") | spelled("b_r", "a_i")))
    return _edges(p, F.when(F.size("b_t") < F.size("a_t"), F.col("b_slug")).otherwise(F.col("a_slug")), "initials")


def glossary(c: DataFrame, terms: DataFrame, output: str) -> DataFrame:
    """terms(group, term, slug, lang): different terms of one group. In two languages ``a`` survives if it is of the
    output language, else ``b``; in one the longer slug, the earlier at equal length."""
    t = F.broadcast(terms)
    hit = c.join(t.withColumnRenamed("slug", "g_slug"), (F.col("slug") == F.col("g_slug")) | (F.lower(T.strip("title")) == F.lower("term")))
    first = hit.withColumn("rn", F.row_number().over(Window.partitionBy("pos").orderBy("group", "term"))).where("rn = 1")
    p = _pairs(first.select(F.col("group").alias("key"), "pos", "slug", "term", "lang")).where("a_term <> b_term")
    longer = F.when(F.length("b_slug") > F.length("a_slug"), F.col("b_slug")).otherwise(F.col("a_slug"))
    into = F.when(F.col("a_lang") == F.col("b_lang"), longer).when(F.col("a_lang") == output, F.col("a_slug")).otherwise(F.col("b_slug"))
    return _edges(p, into, "glossary")


def region_clusters(c: DataFrame) -> DataFrame:
    """``(members, class, into, signal)``: 2 to 4 forms of one core, ``region-x`` before ``x-region`` before ``x``."""
    k = c.withColumn("f", T.region_form("slug")).select(F.col("f.core").alias("core"), F.col("f.form").alias("form"), "slug").where((F.length("core") >= 3) & ~F.col("core").contains("region")).distinct()
    rank = F.when(F.col("form") == "prefix", 0).when(F.col("form") == "suffix", 1).otherwise(2)
    g = k.groupBy("core").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "slug"))).alias("m")).where(F.size("m").between(2, 4))
    return g.select(F.transform("m", lambda x: x["slug"]).alias("members"), F.lit(5).alias("class"), F.col("m")[0]["slug"].alias("into"), F.lit("region-form").alias("signal"))


def indicator_clusters(c: DataFrame) -> DataFrame:
    """An indicator and the bare page of its name; the indicator leads."""
    i = c.withColumn("i", T.indicator("slug")).where("i.name is not null").select(F.col("slug").alias("into"), F.col("i.name").alias("slug"))
    return i.join(c.select("slug"), "slug").select(F.array("into", "slug").alias("members"), F.lit(3).alias("class"), "into", F.lit("indicator-concept").alias("signal"))


def detect(c: DataFrame, lang: str, corpus: DataFrame | None = None, terms: DataFrame | None = None, never: DataFrame | None = None, veto: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``pairs(from, into, signal, tier)`` with tier auto, proposed or vetoed, and ``clusters(members, class, into, signal, vetoed)``.

    A pair inside a cluster is the cluster's; of several signals the first by rank names the pair, ties by candidate
    place. never(a, b) and veto(slug) turn automatic merges into vetoed ones; a never pair inside a cluster vetoes all of it.
    """
    edges = transliteration(c, lang).unionByName(alias(c, lang)).unionByName(edit_distance(c)).unionByName(indicator_form(c)).unionByName(subsequence(c)).unionByName(initials(c, lang))
    if corpus is not None:
        edges = edges.unionByName(abbreviation(c, corpus, lang))
    if terms is not None:
        edges = edges.unionByName(glossary(c, terms, lang))
    clusters = region_clusters(c).unionByName(indicator_clusters(c))
    inside = clusters.select(F.explode("members").alias("a"), "members").select("a", F.explode("members").alias("b")).where("a < b").distinct()
    rank = F.array_position(F.array(*[F.lit(x) for x in RANK]), F.col("signal"))
    keyed = edges.withColumn("a", F.least("from", "into")).withColumn("b", F.greatest("from", "into")).join(inside, ["a", "b"], "left_anti")
    w = Window.partitionBy("a", "b").orderBy(rank, "a_pos", "b_pos", "into")
    pairs = keyed.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    auto = F.col("signal").isin(*AUTO)
    bad = F.lit(False)
    if never is not None:
        n = never.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("__n")).distinct()
        pairs = pairs.join(n, ["a", "b"], "left")
        bad = bad | F.coalesce("__n", F.lit(False))
        flagged = clusters.withColumn("x", F.explode("members")).withColumn("y", F.explode("members")).join(n.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"]).select("members").distinct()
        clusters = clusters.join(flagged.withColumn("vetoed", F.lit(True)), "members", "left").withColumn("vetoed", F.coalesce("vetoed", F.lit(False)))
    else:
        clusters = clusters.withColumn("vetoed", F.lit(False))
    if veto is not None:
        v = veto.select("slug").distinct()
        pairs = pairs.join(v.select(F.col("slug").alias("a"), F.lit(True).alias("__va")), "a", "left").join(v.select(F.col("slug").alias("b"), F.lit(True).alias("__vb")), "b", "left")
        bad = bad | F.coalesce("__va", "__vb", F.lit(False))
    tier = F.when(auto & bad, "vetoed").when(auto, "auto").otherwise("proposed")
    return pairs.select("from", "into", "signal", tier.alias("tier")), clusters


# ---- queries

_WORDS = r"select distinct unnest(regexp_extract_all(lower(text), '[a-z]{10,}')) as slug from documents"
_EDIT_SQL = f"""with c as ({_WORDS}), p as (select a.slug as x, b.slug as y from c a join c b on a.slug[1:5] = b.slug[1:5] and a.slug < b.slug and abs(length(a.slug) - length(b.slug)) <= 2)
  select case when length(y) > length(x) then x else y end as "from", case when length(y) > length(x) then y else x end as "into", 'edit-distance' as signal from p
  where x[1:ceil(least(length(x), length(y)) / 2)::int] = y[1:ceil(least(length(x), length(y)) / 2)::int] and levenshtein(x, y) <= 2"""


@query("edit_distance_pairs", _EDIT_SQL)
def edit_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of the documents as candidates, in the order of the words."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{10,}"), F.lit(0)))).alias("slug")).distinct()
    return edit_distance(words.withColumn("pos", F.col("slug"))).drop("a_pos", "b_pos")


@query(
    "region_families",
    """with c as (select lower(r_name) as core from region), f as (select core, 2 as r, replace(core, ' ', '-') as slug from c union all select core, 0, 'region-' || replace(core, ' ', '-') from c
    union all select core, 1, replace(core, ' ', '-') || '-region' from c where core like 'a%') select string_agg(slug, ' ' order by r) as members, arg_min(slug, r) as "into" from f group by core""",
)
def region_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = table(spark, sf_dir, "region").select(T.slugify("r_name").alias("core"))
    slugs = core.select(F.col("core").alias("slug")).union(core.select(F.concat(F.lit("region-"), "core"))).union(core.where("core like 'a%'").select(F.concat("core", F.lit("-region"))))
    return region_clusters(slugs).select(F.array_join("members", " ").alias("members"), "into")


@query(
    "token_subsequence_pairs",
    """with p as (select distinct replace(lower(p_name), ' ', '-') as name, replace(lower(split_part(p_brand, '#', 1)), ' ', '-') as brand from part)
    select distinct split_part(name, '-', 1) || '-' || brand || 'x-' || split_part(name, '-', 2) as "from", name as "into" from p""",
)
def token_subsequence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, and the same with a brand word in the middle."""
    p = table(spark, sf_dir, "part").select(T.slugify("p_name").alias("name"), T.slugify(F.substring_index("p_brand", "#", 1)).alias("brand"))
    longer = F.concat(F.substring_index("name", "-", 1), F.lit("-"), "brand", F.lit("x-"), F.substring_index("name", "-", -1))
    c = p.select(F.col("name").alias("slug")).union(p.select(longer)).distinct()
    return subsequence(c.withColumn("pos", F.col("slug"))).select("from", "into").distinct()
