"""Line-first quality rules.

Each line is judged by itself; failing lines go; a document that lost too much of its text goes as a whole. Everything
is a Spark expression over the array of lines: no shuffle, no Python. What is used twice in a line's rules is bound once,
and the kept documents come out of a generator, which the optimizer doesn't compute a second time for the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import table

#: A line of prose ends like this (punctuation rule, with MARKS and SHOUT).
ENDING = r"""[.!?:;,…"'”’»)\]]$"""
#: Symbols that prose has few of, and runs of exclamation marks.
MARKS = r"[#$%&*^~<>{}\\]"
SHOUT = r"!!"
#: Separators of menus and breadcrumbs.
SEPARATORS = r"[|»›•·→]"
#: Whole lines of menus, and phrases of boilerplate, in English, German, French and Spanish; both are matched in lower case.
NAVIGATION = (
    r"^(home|menu|search|log ?in|sign ?(in|up)|next|previous|back to top|read more|skip to [a-z ]+|share( this)?|about( us)?|contact( us)?|site ?map"
    r"|startseite|suche|anmelden|registrieren|weiter|zurück|nach oben|zum seitenanfang|weiterlesen|mehr lesen|zum inhalt springen|teilen|über uns|kontakt|impressum"
    r"|accueil|rechercher|connexion|se connecter|s'inscrire|suivant|précédent|haut de page|retour en haut|lire la suite|aller au contenu|partager|à propos|contactez-nous|plan du site"
    r"|inicio|menú|buscar|iniciar sesión|registrarse|siguiente|anterior|volver arriba|leer más|ir al contenido|compartir|acerca de|contacto|mapa del sitio)[.!:]?$"
)
PHRASES = (
    "all rights reserved|terms of use|terms of service|terms of conditions|terms and use|terms and service|terms and conditions|privacy policy|cookie policy|cookie settings|cookie notice|we use cookies|enable javascript|lorem ipsum|click here|subscribe to our|powered by "
    "|alle rechte vorbehalten|allgemeine geschäftsbedingungen|nutzungsbedingungen|datenschutzerklärung|cookie-einstellungen|wir verwenden cookies|javascript aktivieren|klicken sie hier|newsletter abonnieren"
    "|tous droits réservés|conditions d'utilisation|conditions générales|politique de confidentialité|nous utilisons des cookies|activer javascript|cliquez ici|abonnez-vous à"
    "|todos los derechos reservados|términos y condiciones|condiciones de uso|política de privacidad|política de cookies|utilizamos cookies|active javascript|haga clic aquí|suscríbete a"
).split("|")

MAX_MARKS, MAX_SHOUTS, MAX_SEPARATORS = 0.05, 2, 2
#: A line of at least REPEAT_WORDS words whose distinct words are fewer than this share repeats itself (boilerplate rule).
REPEAT_WORDS, MIN_DISTINCT = 12, 0.3
#: A line without an ending still passes as a heading or verse line when it is short.
SHORT = 60
#: A document stays when it keeps at least this share of the characters of its lines.
MIN_KEPT = 0.5


def _any_of(x: Column, phrases: list[str]) -> Column:
    """Whether ``x`` contains a phrase: searches for fixed bytes, which Spark does faster than one pattern of all phrases."""
    found = x.contains(phrases[0])
    for p in phrases[1:]:
        found = found | x.contains(p)
    return found


def _line_passes(t: Column, low: Column, n: Column) -> Column:
    """A trimmed line, the same in lower case, its length. Of the tests the cheap ones come first."""
    words = F.transform(F.array(F.split(low, " +")), lambda w: (F.size(w) < REPEAT_WORDS) | (F.size(F.array_distinct(w)) >= MIN_DISTINCT * F.size(w)))[0]
    return (
        ((n <= SHORT) | t.rlike(ENDING))
        & ~_any_of(low, PHRASES)
        & ((n > SHORT) | ~low.rlike(NAVIGATION))  # no entry of a menu is longer, but for "skip to"
        & ((n <= SHORT) | ~low.startswith("skip to ") | ~low.rlike(NAVIGATION))
        & (F.regexp_count(t, F.lit(MARKS)) <= MAX_MARKS * n)
        & (~t.contains(SHOUT) | (F.regexp_count(t, F.lit(SHOUT)) <= MAX_SHOUTS))
        & (F.regexp_count(t, F.lit(SEPARATORS)) <= MAX_SEPARATORS)
        & ((n < 2 * REPEAT_WORDS - 1) | words)  # so many words need so many letters and blanks
    )


def _judged(docs: DataFrame, min_kept: float) -> DataFrame:
    """``docs`` that stay with ``__q``: the kept lines, and the numbers behind the decision."""

    def line(x: Column) -> Column:
        """The line, its letters without blanks at the ends, and whether it stays."""
        bound = F.transform(F.array(F.trim(x)), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"), F.length(t).alias("n")))
        return F.transform(bound, lambda b: F.struct(x.alias("line"), b["n"].alias("n"), ((b["n"] == 0) | _line_passes(b["t"], b["low"], b["n"])).alias("stays")))[0]

    chars = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x["n"])
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line)

    def decided(every: Column, kept: Column) -> Column:
        return F.struct(F.transform(kept, lambda x: x["line"]).alias("kept"), F.size(every).alias("lines"), chars(every).alias("chars"), chars(kept).alias("kept_chars"))

    both = F.transform(F.transform(F.array(lines), lambda a: F.struct(a.alias("a"), F.filter(a, lambda x: x["stays"]).alias("k"))), lambda b: decided(b["a"], b["k"]))
    good = F.filter(both, lambda q: (q["chars"] > 0) & (q["kept_chars"] >= min_kept * q["chars"]))
    return docs.select("*", F.explode(good).alias("__q"))


def clean(docs: DataFrame, min_kept: float = MIN_KEPT) -> DataFrame:
    """The documents that stay, with all their columns; ``text`` holds the lines that passed, blank lines stay where they
    were, ``n_chars`` follows.

    A null, empty or blank text has nothing to keep: the document goes. A text of one very long line is one line. Other
    nulls, repeated rows and further columns pass through; each row is judged alone. An empty table gives an empty one.
    """
    out = _judged(docs, min_kept).withColumn("text", F.array_join("__q.kept", "\n"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def report(docs: DataFrame, min_kept: float = MIN_KEPT) -> DataFrame:
    """``doc_id``, cleaned ``text`` and the counts behind the decision, for the documents that stay; cases as in ``clean``."""
    out = _judged(docs.select("doc_id", "text"), min_kept)
    return out.select(
        "doc_id",
        F.array_join("__q.kept", "\n").alias("text"),
        F.col("__q.lines").cast("long").alias("n_lines"),
        F.size("__q.kept").cast("long").alias("n_kept_lines"),
        F.col("__q.chars").cast("long").alias("line_chars"),
        F.col("__q.kept_chars").cast("long").alias("kept_chars"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql() -> str:
    t = "trim(x, ' ')"
    n = lambda p: f"len(regexp_extract_all({t}, {_sql_text(p)}))"
    words = f"regexp_split_to_array(lower({t}), ' +')"
    phrases = " or ".join(f"contains(lower({t}), {_sql_text(p)})" for p in PHRASES)
    passes = (
        f"(regexp_matches({t}, {_sql_text(ENDING)}) or length({t}) <= {SHORT}) and {n(MARKS)} <= {MAX_MARKS}::double * length({t})"
        f" and {n(SHOUT)} <= {MAX_SHOUTS} and {n(SEPARATORS)} <= {MAX_SEPARATORS}"
        f" and not regexp_matches(lower({t}), {_sql_text(NAVIGATION)}) and not ({phrases})"
        f" and (len({words}) < {REPEAT_WORDS} or len(list_distinct({words})) >= {MIN_DISTINCT}::double * len({words}))"
    )
    chars = lambda a: f"coalesce(list_sum(list_transform({a}, lambda x: length({t}))), 0)::bigint"
    return f"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
k as (select doc_id, lines, list_filter(lines, lambda x: {t} = '' or ({passes})) as kept from l),
c as (select doc_id, array_to_string(kept, chr(10)) as text, len(lines)::bigint as n_lines, len(kept)::bigint as n_kept_lines,
      {chars('lines')} as line_chars, {chars('kept')} as kept_chars from k)
select * from c where line_chars > 0 and kept_chars >= {MIN_KEPT}::double * line_chars"""


QUERIES = {"op2_quality": op2_quality}
ORACLES = {"op2_quality": _sql()}
