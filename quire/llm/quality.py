"""Line-first cleaning with DataFrame functions only.

Every line is tested alone by the rules for punctuation, navigation and boilerplate; lines that
fail are removed, and a document that loses too much of its text that way is rejected. All of it
is a projection of the row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import SPACES, whole_text

#: fixed values of the counts every document gets
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = r"[#*$%&|<>]"
#: a line fails with more marks than MARKS_FREE + MARKS_PERCENT of its letters and marks
MARKS, MARKS_FREE, MARKS_PERCENT = r"[\p{P}\p{S}]", 2, 12
#: a line of so many words needs a mark that ends or parts a sentence
LONG_LINE, SENTENCE = 12, r"[.,;:!?…。！？、]"
#: a line with so many separators and at most so many words to each is a menu
SEPARATORS, MIN_SEPARATORS, WORDS_EACH = r"[|»›>·•]", 2, 5
#: lines that are nothing but one of these are menu entries, by language; fixed values
MENU_ENTRIES = {
    "en": "home|menu|search|login|log in|sign in|sign up|register|next|next page|previous"
          "|previous page|back|back to top|skip to content|read more|load more|share|contact us"
          "|about us|sitemap",
    "fr": "accueil|menu|rechercher|recherche|connexion|se connecter|s'inscrire|inscription|suivant"
          "|page suivante|pr[éÉ]c[éÉ]dent|page pr[éÉ]c[éÉ]dente|retour|retour en haut|haut de page"
          "|aller au contenu|lire la suite|en savoir plus|partager|contactez-nous|plan du site"
          "|qui sommes-nous",
    "de": "startseite|men[üÜ]|suche|suchen|anmelden|einloggen|registrieren|weiter|n[äÄ]chste seite"
          "|zur[üÜ]ck|vorherige seite|nach oben|zum inhalt springen|weiterlesen|mehr lesen"
          "|mehr erfahren|teilen|kontakt|[üÜ]ber uns|impressum",
    "es": "inicio|men[úÚ]|buscar|b[úÚ]squeda|iniciar sesi[óÓ]n|acceder|registrarse|reg[íÍ]strate"
          "|siguiente|p[áÁ]gina siguiente|anterior|p[áÁ]gina anterior|volver|volver arriba"
          "|ir al contenido|saltar al contenido|leer m[áÁ]s|ver m[áÁ]s|compartir|contacto"
          "|sobre nosotros|mapa del sitio",
}
#: phrases of page furniture, by language; fixed values
FURNITURE = {
    "en": "all rights reserved|privacy policy|cookie policy|uses cookies|accept cookies"
          "|terms of use|terms of service|enable javascript|click here|lorem ipsum"
          "|subscribe to our newsletter|powered by",
    "fr": "tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|mentions l[éÉ]gales"
          "|utilise des cookies|accepter les cookies|conditions d'utilisation"
          "|activer javascript|cliquez ici|inscrivez-vous [àÀ] notre newsletter|propuls[éÉ] par",
    "de": "alle rechte vorbehalten|datenschutzerkl[äÄ]rung|cookie-richtlinie|verwendet cookies"
          "|cookies akzeptieren|nutzungsbedingungen|javascript aktivieren|klicken sie hier"
          "|hier klicken|newsletter abonnieren|allgemeine gesch[äÄ]ftsbedingungen",
    "es": "todos los derechos reservados|pol[íÍ]tica de privacidad|pol[íÍ]tica de cookies"
          "|utiliza cookies|usa cookies|aceptar cookies|t[éÉ]rminos de uso|condiciones de uso"
          "|aviso legal|activar javascript|haga clic aqu[íÍ]|haz clic aqu[íÍ]"
          "|suscr[íÍ]bete a nuestro bolet[íÍ]n",
}
MENU = rf"(?i)^\W*({'|'.join(MENU_ENTRIES.values()).replace(chr(39), '.')})\W*$"
#: a phrase begins a line or follows a space or one of these marks
BOILERPLATE = (r"(?i)(^|[\x20\x09-\x0D(\[>\"«¿¡,.;:|©-])"
               rf"({'|'.join(FURNITURE.values()).replace(chr(39), '.')})")
#: percent of a line's characters in words that such phrases need for the line to fail
BOILERPLATE_PERCENT = 25
#: percent of the characters in words that may go with the lines
MAX_LOST_PERCENT = 30
_SPACE = r"[\x20\x09-\x0D]+"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, "")


def words_of(text: Column) -> Column:
    """Words between spaces and control characters; no words give an empty array."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACE))


def failed_rule(line: Column) -> Column:
    """Name of the first rule that a line fails, null if none; blank lines fail none."""
    bare = F.length(_bare(line))
    words = F.when(bare == 0, 0).otherwise(_found(line, r"[^\x20\x09-\x0D]+"))
    marks = _found(line, MARKS)
    separators = _found(line, SEPARATORS)
    return (
        F.when(bare == 0, F.lit(None).cast("string"))
        .when((separators >= MIN_SEPARATORS) & (words <= WORDS_EACH * (separators + 1)),
              "navigation")
        .when(line.rlike(MENU), "navigation")
        .when(marks * 100 > MARKS_FREE * 100 + MARKS_PERCENT * bare, "punctuation")
        .when((words >= LONG_LINE) & ~line.rlike(SENTENCE), "punctuation")
        .when(line.rlike(BOILERPLATE) & ((bare - F.length(_bare(F.regexp_replace(
            line, BOILERPLATE, "")))) * 100 >= BOILERPLATE_PERCENT * bare), "boilerplate")
    )


def _free(names: list[str], wanted: str) -> str:
    taken = {n.lower() for n in names}
    while wanted in taken:
        wanted += "_"
    return wanted


def judged(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and a struct column ``name`` with the counts, the cleaned text and the verdict."""
    column = docs.columns
    steps = [_free([*column, name], f"{name}_{i}") for i in range(4)]
    text = whole_text(docs)
    lines = F.split(text, "\n", -1)

    one = docs.withColumn(steps[0], F.struct(
        words_of(text).alias("words"),
        F.transform(lines, lambda x: F.struct(x.alias("line"), failed_rule(x).alias("rule")))
        .alias("lines"),
        F.length(_bare(text)).cast("long").alias("word_chars"),
        _found(text, SYMBOLS).cast("long").alias("n_symbols"),
    ))
    a = F.col(steps[0])
    words, n = a["words"], F.size(a["words"])
    at = F.sequence(F.lit(0), n - WINDOW)
    windows = F.when(n >= WINDOW, F.transform(at, lambda i: F.xxhash64(
        *[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    two = one.withColumn(steps[1], windows)
    w = F.col(steps[1])
    # equal windows meet in a sorted array; only rows that have any are sorted
    twice = F.size(F.array_distinct(w)) < F.size(w)
    three = two.withColumn(steps[2], F.when(twice, F.sort_array(
        F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))))
    s = F.col(steps[2])
    starts = F.array_sort(F.filter(F.transform(s, lambda e, j: F.when(
        (e["w"] == F.get(s, j - 1)["w"]) | (e["w"] == F.get(s, j + 1)["w"]), e["i"])),
        lambda i: i.isNotNull()))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"),
                                p.alias("last")),
        lambda acc: acc["n"])
    full = F.transform(F.filter(a["lines"], lambda x: F.length(_bare(x["line"])) > 0),
                       lambda x: x["line"])
    failed = F.filter(a["lines"], lambda x: x["rule"].isNotNull())
    four = three.withColumn(steps[3], F.struct(
        n.cast("long").alias("n_words"), a["word_chars"].alias("word_chars"),
        a["n_symbols"].alias("n_symbols"), full.alias("full"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join(F.transform(F.filter(a["lines"], lambda x: x["rule"].isNull()),
                                 lambda x: x["line"]), "\n").alias("clean_text"),
        F.transform(failed, lambda x: x["rule"]).alias("rules"),
        F.length(_bare(F.array_join(F.transform(failed, lambda x: x["line"]), ""))).cast("long")
        .alias("lost_chars"),
    ))
    b = F.col(steps[3])
    failed_base = (b["n_words"] < MIN_WORDS) | (
        b["n_repeat_words"] * 100 > b["n_words"] * MAX_REPEAT_PERCENT)
    enough = b["lost_chars"] * 100 <= b["word_chars"] * MAX_LOST_PERCENT

    def lines_by(rule: str) -> Column:
        return F.size(F.filter(b["rules"], lambda r: r == rule)).cast("long").alias(f"n_{rule}")

    return four.select(*column, F.struct(
        b["n_words"].alias("n_words"), b["word_chars"].alias("word_chars"),
        b["n_symbols"].alias("n_symbols"),
        (F.size(b["full"]) - F.size(F.array_distinct(b["full"]))).cast("long")
        .alias("n_dup_lines"),
        b["n_repeat_words"].alias("n_repeat_words"), failed_base.alias("base_failed"),
        (~failed_base & enough).alias("kept"), lines_by("punctuation"), lines_by("navigation"),
        lines_by("boilerplate"), b["lost_chars"].alias("lost_chars"),
        b["clean_text"].alias("clean_text"),
    ).alias(name))


def line_quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts of its whole text, base_failed, kept.

    Null and empty texts have no words, so they fail the base; repeated rows are judged each,
    rows without doc_id too. No rows give no rows; other columns, whatever their names, are not
    read. clean_text is the text without the lines that failed a rule.
    """
    return judged(docs.select("doc_id", "text"), "verdict").select("doc_id", "verdict.*")


def clean_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, with the failed lines removed from text.

    A column n_chars becomes the length of the text that is left. Null and empty texts fail the
    base and go; rows without doc_id and repeated rows are judged each. Other columns stay as they
    are, whatever their names; no rows give no rows.
    """
    name = _free(docs.columns, "line_verdict")
    # an explode, since a filter would be moved below the arrays and evaluate them again
    kept = F.filter(F.array(F.col(name)), lambda v: v["kept"])
    found = judged(docs, name).select(*docs.columns, F.explode(kept).alias(name))
    clean = F.col(name)["clean_text"]
    now = {"text": F.when(F.col("text").isNotNull(), clean)}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(F.col("n_chars").isNotNull(), F.length(clean).cast(
            docs.schema["n_chars"].dataType))
    return found.withColumns(now).select(*docs.columns)


SQL = rf"""
    WITH t AS (
        SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents),
    w AS (
        SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
               string_split(text, chr(10)) AS lines
        FROM t),
    spans AS (
        SELECT row_no, i, list_slice(words, i, i + 2) AS span
        FROM w, unnest(range(1, greatest(len(words) - 1, 1))) AS r(i)),
    again AS (SELECT row_no, span FROM spans GROUP BY row_no, span HAVING count(*) > 1),
    covered AS (
        SELECT row_no, count(DISTINCT i + k) AS n
        FROM spans JOIN again USING (row_no, span), unnest([0, 1, 2]) AS o(k)
        GROUP BY row_no),
    line AS (
        SELECT row_no, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS bare,
               len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
               len(regexp_extract_all(line, '{SEPARATORS}')) AS seps,
               len(regexp_extract_all(line, '{MARKS}')) AS marks
        FROM w, unnest(lines) AS l(line)),
    rules AS (
        SELECT row_no, line, bare, CASE
            WHEN bare = 0 THEN NULL
            WHEN seps >= {MIN_SEPARATORS} AND n <= {WORDS_EACH} * (seps + 1) THEN 'navigation'
            WHEN regexp_matches(line, '{MENU}') THEN 'navigation'
            WHEN marks * 100 > {MARKS_FREE * 100} + {MARKS_PERCENT} * bare THEN 'punctuation'
            WHEN n >= {LONG_LINE} AND NOT regexp_matches(line, '{SENTENCE}') THEN 'punctuation'
            WHEN regexp_matches(line, '{BOILERPLATE}') AND 100 * (bare - length(regexp_replace(
                regexp_replace(line, '{BOILERPLATE}', '', 'g'), '[\x20\x09-\x0D]+', '', 'g')))
                >= {BOILERPLATE_PERCENT} * bare THEN 'boilerplate' END AS rule
        FROM line),
    by_row AS (
        SELECT row_no, count(*) FILTER (bare > 0) - count(DISTINCT line) FILTER (bare > 0) AS dup,
               count(*) FILTER (rule = 'punctuation') AS n_punctuation,
               count(*) FILTER (rule = 'navigation') AS n_navigation,
               count(*) FILTER (rule = 'boilerplate') AS n_boilerplate,
               coalesce(sum(bare) FILTER (rule IS NOT NULL), 0)::BIGINT AS lost_chars
        FROM rules GROUP BY row_no),
    counts AS (
        SELECT doc_id, len(words)::BIGINT AS n_words,
               length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
               len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
               dup AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
               n_punctuation, n_navigation, n_boilerplate, lost_chars
        FROM w JOIN by_row USING (row_no) LEFT JOIN covered USING (row_no))
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words
               AS base_failed,
           NOT base_failed AND lost_chars * 100 <= word_chars * {MAX_LOST_PERCENT} AS kept
    FROM counts"""
