"""Template residue, filler, error pages and script notices that stand where content belongs.

Texts are cut into segments (sentences and lines); numbers and identifiers are masked, so that a
response that recurs has one signature. A signature is judged by evidence pooled over the whole corpus:

* address (agenda_id) and title (agenda_item): it stands under different addresses and shares no term with any title it stands under
* body: it makes up bodies alone, or stands several times in a row where it stands at all
* information: its words are technical terms (their number and their share), or status codes and
  traces of programs, or one word over and over; words of speakers speak against it
* host (source): the share of residue, against that of the corpus, decides where one point is missing

Placeholders are found by template syntax, and by instructions or field names in brackets. Dummy text of
any vocabulary is found by statistics: several segments without any of the words that are common in
the corpus and without short words. What stands in quotation marks is mentioned, not content, and is
taken out before. Fixed values below are plain lists of terms in the four languages of the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ultradia.operators.linking import Written

#: Template syntax, over folded text without quoted parts.
SYNTAX = (
    r"\{\{[^{}\n]++\}\}",
    r"[$#]\{[^{}\n]++\}",
    r"<%[^%\n]++%>",
    r"\{%[^%\n]++%\}",
    r"\[\[[^\[\]\n]++\]\]",
    r"@@[a-z_]++@@",
    r"%[a-z][a-z_]+%",
    r"%\([a-z_]++\)[sd]",
    r"\$[a-z][a-z_]+\$",
    r"\{[0-9]{1,2}\}",
)
#: Words that ask to fill something in (accents off).
INSTRUCTIONS = (
    "insert", "enter", "fill", "type", "replace", "choose", "add", "confirmed", "added", "determined", "completed", "tbc", "tbd", "todo", "follow", "follows", "pending", "placeholder",
    "einfugen", "einsetzen", "eintragen", "eingeben", "erganzen", "ausfullen", "auswahlen", "ersetzen", "nachtragen", "folgt", "folgen", "platzhalter",
    "inserer", "completer", "preciser", "remplir", "remplacer", "indiquer", "saisir", "ajouter", "choisir", "venir", "confirmer",
    "insertar", "completar", "rellenar", "introducir", "indicar", "sustituir", "anadir", "elegir", "confirmar", "determinar", "precisar", "pendiente",
)
#: Words that end, and field names that begin, what a bracket of a template holds.
LAST = ("here", "hier", "ici", "aqui")
FIELDS = ("name", "nom", "nombre", "title", "titel", "titre", "titulo", "date", "datum", "fecha", "text", "texte", "texto")
#: Technical terms of error pages and browser notices (accents off).
TECHNICAL = (
    "access", "accessible", "activate", "allowed", "app", "browser", "cache", "captcha", "connection", "cookie", "cookies", "database", "denied", "disabled", "disconnect", "display", "displayed", "enable", "enabled", "error",
    "exception", "exist", "expired", "failed", "failure", "fatal", "gateway", "headers", "http", "https", "incident", "internal", "javascript", "js", "load", "loading", "login", "maintenance", "method", "moved", "network", "noscript", "oops",
    "page", "permission", "proxy", "redirect", "refused", "reload", "request", "requested", "requests", "required", "requires", "reset", "retry", "script", "scripting", "scripts", "seconds", "server", "service", "session", "settings",
    "sorry", "support", "temporarily", "timeout", "traceback", "unauthorized", "unavailable", "undefined", "unexpected", "unsupported", "upstream", "url", "viewer", "website", "wrong",
    "abgelaufen", "aktivieren", "aktivierte", "aktiviert", "anfrage", "anfragen", "angeforderte", "anmelden", "anzuzeigen", "benotigt", "datenbank", "deaktiviert", "dienst", "erforderlich", "erneut", "fehler", "gefunden", "interner", "netzwerk", "neu", "seite",
    "melden", "serverfehler", "skript", "skripte", "spater", "unterstutzt", "verbindung", "verfugbar", "verweigert", "voruber", "vorubergehend", "wartung", "zugriff",
    "acces", "activer", "activez", "active", "activa", "connexion", "demandee", "desactive", "erreur", "execution", "expire", "indisponible", "interne", "introuvable", "navigateur", "necessite", "recharger", "refuse", "requete", "requetes", "reessayez", "serveur", "temporairement", "trouvee",
    "acceso", "caducado", "conexion", "denegado", "desactivado", "disponible", "ejecucion", "encontrada", "expirado", "habilite", "interno", "intentelo", "navegador", "pagina", "requiere", "servicio", "servidor", "solicitud", "temporalmente",
)
#: Terms for text that only holds a place (accents off).
HOLDING = (
    "placeholder", "dummy", "filler", "sample", "layout", "lipsum", "copy", "blindtext", "mustertext", "beispieltext", "fulltext", "platzhalter", "platzhaltertext", "exemple", "remplissage", "remplacer", "maquette", "fictif",
    "relleno", "ejemplo", "maqueta", "provisional", "sustituir", "replace", "ersetzen",
)
#: The beginning of the usual dummy text, as printers know it.
LOREM = ("lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "eiusmod", "tempor", "incididunt", "labore", "dolore", "magna", "aliqua", "veniam", "nostrud", "exercitation", "ullamco", "laboris")
#: Words of the reason phrases that belong to HTTP status codes, and their usual translations.
REASONS = (
    "bad", "request", "unauthorized", "payment", "required", "forbidden", "not", "found", "method", "allowed", "acceptable", "conflict", "gone", "too", "many", "requests", "internal", "server", "error", "implemented", "gateway", "service",
    "unavailable", "timeout", "time", "out", "http", "status", "code", "fehler", "erreur", "page", "introuvable", "trouvee", "non", "seite", "nicht", "gefunden", "pagina", "no", "encontrada", "interne", "interner", "serverfehler", "du", "serveur", "interno", "del", "servidor",
)
#: What speakers say of themselves, to one another and of their house.
SPEAKERS = (
    "i", "we", "my", "minister", "ministers", "government", "house", "member", "members", "president", "speaker", "petition", "petitions", "citizens", "constituents", "amendment", "amendments", "motion", "clause", "bill",
    "ich", "wir", "uns", "herr", "frau", "minister", "regierung", "abgeordnete", "antrag", "burger", "niemand", "menschen", "formular", "nous", "je", "monsieur", "madame", "notre", "petition", "ministre", "gouvernement", "amendement", "citoyens", "impossible",
    "senorias", "nosotros", "senor", "senora", "ministro", "gobierno", "enmienda", "ciudadanos", "tramite", "beifall", "applause", "applaudissements", "aplausos",
)
ACCENTS = "àáâãäåāçèéêëēìíîïīñòóôõöøōùúûüūýÿ"
PLAIN = "aaaaaaaceeeeeiiiiinooooooouuuuuyy"
#: What programs print when they fail, by form (numbers are masked).
MACHINE = (
    r"\b[a-z_$][a-z0-9_$]*(?:\.[a-z_$][a-z0-9_$]*)+\(",
    r"\b[a-z]+(?:\.[a-z0-9_]+)+(?:exception|error)\b|\b[a-z]{3,}(?:exception|error):?$",
    r"\b[a-z_]+::[a-z_]+\(",
    r"\bfile \"[^\"\n]+\" *,? line ",
    r"(?:^|[ (])/[a-z0-9_]+/[a-z0-9_./]+\.[a-z]{1,4}\b",
    r"\bsqlstate\b|\bsegmentation fault\b|\btraceback \(",
)
TAGS_RE = r"(?i)</?(?:html|head|body|title|h[1-6]|div|pre|script|!doctype)\b[^<>]*>"
STATUS_RE = r"(?<![0-9#.,/:-])[45][0-9]{2}(?![0-9])"
INSIDE = r"[^\[\]<>{}\n*]*?"


def _any(parts: Sequence[str]) -> str:
    return "(?:" + "|".join(parts) + ")"


def _bracketed() -> str:
    """An instruction or field name in square, angle or curly brackets, doubled or with dots, or between underscores or asterisks."""
    body = rf"(?:{INSIDE}(?<![a-z]){_any(INSTRUCTIONS)}(?![a-z]){INSIDE}|{INSIDE}(?<![a-z]){_any([*LAST, *FIELDS])}[ …]?|[ …]?{_any(FIELDS)}(?![a-z]){INSIDE})"
    return rf"(?:\[{body}(?:\]|$)|<{body}>|\{{{body}\}}|__{body}(?:__|$)|\*\*\*{body}(?:\*\*\*|$))"


SYNTAX_RE = _any(SYNTAX)
BRACKET_RE = _bracketed()
MACHINE_RE = _any(MACHINE)


def without_quotes(text: Column) -> Column:
    quoted = F.contains(text, F.lit("“")) | F.contains(text, F.lit("„")) | F.contains(text, F.lit("«"))
    return F.when(quoted, F.regexp_replace(text, "“[^“”„«»]*+[”“]|„[^“”„«»]*+[“”]|« ?[^“”„«»]*+»", "“”")).otherwise(text)


def segments(text: Column) -> Column:
    """The sentences and lines of a text without quotes: tags apart; numbers masked, but for numbers from 400 to 599."""
    t = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<(?=/?[a-zA-Z!])[^<>]*+>", "\n$0\n")).otherwise(text)
    t = F.regexp_replace(t, r"(?=[0-9])(?<![0-9])(?!(?<![0-9a-zA-Z])[45][0-9]{2}(?![0-9a-f]|[.,/:-][0-9a-z]))[0-9a-f]++(?:[.,/:-][0-9a-f]++)*+", "#")
    return F.split(t, r"\n|\s(?<=[.!?…:;–)\]>}]\s)")


def folded(part: Column) -> Column:
    """Lower case; accents, marks and odd blanks off; ligatures whole; letters of identifiers before a masked number off."""
    t = F.regexp_replace(F.lower(part), "\\b[a-f]+(?=#)|[­​-‏⁠﻿\\p{M}]", "")
    t = F.replace(F.replace(F.translate(t, ACCENTS, PLAIN), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.trim(F.regexp_replace(t, "[\\h\\s]+", " "))


def words(segment: Column) -> Column:
    return F.filter(F.split(segment, r"(?<=\b[a-z])['’]|[^a-zß-ÿ’']+"), lambda w: w != "")


def _literal(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in sorted(set(terms))])


def evidence(documents: DataFrame) -> DataFrame:
    """doc_id, address (hash of agenda_id), source, title (agenda_item), parts (segments), repeats (which of them are the same as the one before), is_placeholder.

    is_placeholder: template syntax in the whole text. Null and blank texts have no segments.
    """
    rows = documents.select(
        "doc_id",
        F.xxhash64("agenda_id").alias("address"),
        F.col("source").cast("string").alias("source"),
        F.lower(F.coalesce("agenda_item", F.lit(""))).alias("title"),
        F.coalesce(without_quotes(F.col("text")), F.lit("")).alias("body"),
    )
    signs = F.contains("body", F.lit("%")) & F.col("body").rlike("%[A-Za-z(]") | F.contains("body", F.lit("$")) & F.col("body").rlike(r"\$[A-Za-z]")
    for sign in ("{", "@@", "<%", "[["):
        signs = signs | F.contains("body", F.lit(sign))
    cut = rows.withColumn("cut", segments(F.col("body")))
    before = F.concat(F.array(F.lit("")), F.slice("cut", 1, F.greatest(F.size("cut") - 1, F.lit(0))))
    return cut.select(
        "doc_id",
        "address",
        "source",
        "title",
        F.col("cut").alias("parts"),
        F.zip_with("cut", before, lambda x, y: x == y).alias("repeats"),
        F.when(signs, F.lower("body").rlike(SYNTAX_RE)).otherwise(False).alias("is_placeholder"),
    )


def raw_signatures(kept: DataFrame) -> DataFrame:
    """One row per segment as it is written: raw_key, part (folded), key (its hash), n, runs (rows of itself count once), low, high (hashes of addresses), alone (three segments at most)."""
    found = kept.select("address", F.size("parts").alias("size"), F.explode(F.arrays_zip(F.col("parts").alias("raw"), "repeats")).alias("p")).where("p.raw != ''")
    grouped = found.groupBy(F.col("p.raw").alias("raw")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("p.repeats"), 0).otherwise(1)).alias("runs"),
        F.min("address").alias("low"),
        F.max("address").alias("high"),
        F.min("size").alias("least"),
    )
    # that n takes part keeps the filter, and with it the folding, above the aggregate: once per distinct segment
    part = grouped.withColumn("part", folded(F.col("raw"))).where("n > 0 and (part != '' or n < 0)")
    return part.select(F.xxhash64("raw").alias("raw_key"), "part", F.xxhash64("part").alias("key"), "n", "runs", "low", "high", (F.col("least") <= 3).alias("alone"))


def signatures(raw: DataFrame) -> DataFrame:
    """One row per signature: key, part, n, runs, spread (under different addresses), alone, w (its words)."""
    grouped = raw.groupBy("key", "part").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"), (F.min("low") < F.max("high")).alias("spread"), F.max("alone").alias("alone"))
    return grouped.withColumn("w", words(F.col("part")))


LEXICON = {"tech": TECHNICAL, "holding": HOLDING, "lorem": LOREM, "reason": REASONS, "spoken": SPEAKERS}


def counted(parts: DataFrame, share: float = 0.002) -> DataFrame:
    """key, part, n, runs, spread, alone, size (words), and of its distinct words: distinct, long (two letters or more), short (two or three), known (common in the corpus), and those of each list of LEXICON.

    Common is a word in at least ``share`` of all segments: at most (words a segment) / share words, which bounds what is sent along.
    """
    each = parts.select("key", "n", F.explode(F.array_distinct("w")).alias("word"))
    total = parts.agg(F.sum("n").alias("total"))
    common = each.groupBy("word").agg(F.sum("n").alias("in")).join(F.broadcast(total), F.col("in") >= share * F.col("total")).select("word", F.lit(1).alias("known"))
    listed = parts.sparkSession.createDataFrame([(t, *[1 if t in terms else None for terms in LEXICON.values()]) for t in sorted({t for terms in LEXICON.values() for t in terms})], "word string, " + ", ".join(f"{k} int" for k in LEXICON))
    per_key = each.join(F.broadcast(common), "word", "left").join(F.broadcast(listed), "word", "left").groupBy("key").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.count(F.when(F.length("word") > 1, 1)).alias("long"),
        F.count(F.when(F.length("word").between(2, 3), 1)).alias("short"),
        *[F.count(c).alias(c) for c in ("known", *LEXICON)],
    )
    return parts.select("key", "part", "n", "runs", "spread", "alone", F.size("w").alias("size")).join(per_key, "key")


def judged(counts: DataFrame) -> DataFrame:
    """key, points (evidence for a canned response), spread, is_filler, is_machine, is_open (an instruction in brackets), strange (words, if they are no language of the corpus).

    Only signatures with any evidence. A status code with nothing but its reason, or one word repeated, decides alone. Else each
    technical term gives a point, up to three, and their share one more; standing under different
    addresses, making up bodies alone, and runs of itself give the rest. Words of speakers take four, and so
    does a longer segment that announces another. Strange is a signature of three words or more of which at most a tenth are
    common and a tenth short, under one address only or of six words; remarks of transcribers are not.
    """
    c = F.col
    rows = counts
    coded = c("part").rlike(STATUS_RE) & (c("reason") == c("distinct"))
    same_word = ((c("size") >= 4) & (c("distinct") <= 4) & (c("distinct") * 2 <= c("size"))) | c("part").rlike(r"\b([a-z]{4,})(?:,? \1){2,}+\b|^(?:([a-z])\2+[ .]*){2,}$")
    in_runs = (c("size") >= 3) & (((c("n") >= 1.6 * c("runs")) & (c("runs") >= 3)) | (c("n") >= 3 * c("runs")))
    thin = (c("tech") > 0) & (c("tech") * 5 < c("size"))
    announcing = (c("size") >= 4) & c("part").endswith(":")
    technical = F.least(c("tech"), F.lit(3)) + F.when((c("tech") >= 2) & (c("tech") * 10 >= c("size") * 3), 1).when(thin & ~coded, -2).otherwise(0)
    filler = F.when(same_word | (c("lorem") >= 4), 4).otherwise(0) + F.when(in_runs, 3).otherwise(0) + F.when(c("holding") >= 2, 3).otherwise(c("holding"))
    own = F.when(coded, 4).otherwise(0) + technical + filler
    more = F.when(c("spread"), 1).otherwise(0) + F.when(c("alone"), 1).otherwise(0) - F.when(c("spoken") > 0, 4).otherwise(0) - F.when(announcing, 4).otherwise(0)
    strange = (c("long") >= 3) & (c("known") * 10 <= c("long")) & (c("short") * 10 <= c("long")) & ~c("part").rlike(r"^[(\[{<]") & ((c("long") >= 6) | ~F.coalesce("spread", F.lit(False)))
    scored = rows.select(
        "key",
        "spread",
        own.alias("own"),
        (own + more).alias("points"),
        (filler > technical).alias("is_filler"),
        (c("part").rlike(MACHINE_RE) | c("part").rlike(TAGS_RE)).alias("is_machine"),
        c("part").rlike(BRACKET_RE).alias("is_open"),
        F.when(strange, c("long")).alias("strange"),
    )
    kept = scored.withColumn("points", F.when((c("own") > 1) & (c("points") >= 3), c("points"))).drop("own")
    return kept.where("points is not null or is_machine or is_open or strange is not null")


def residue(documents: DataFrame, written: Written, enough: int = 4) -> DataFrame:
    """Every document that is or holds residue: doc_id, is_placeholder, is_filler, is_machine, is_canned.

    is_placeholder: unfilled template syntax; is_machine: output of programs; is_filler: dummy text or a segment that only
    holds a place; is_canned: a segment with ``enough`` points as a response (with one less where its host
    has more residue than the corpus). ``written`` stores a table once and reads it again. Documents that repeat a doc_id are judged
    together; extra columns are ignored; an empty table gives no rows.
    """
    kept = written(evidence(documents), "evidence")
    raw = written(raw_signatures(kept), "segments")
    parts = written(signatures(raw), "signatures")
    verdict = written(raw.select("raw_key", "key").join(judged(counted(parts)), "key"), "verdicts")
    found = kept.select("doc_id", "source", "title", F.explode("parts").alias("raw")).withColumn("raw_key", F.xxhash64("raw"))
    # a response that shares terms with a title it stands under, anywhere, is none
    shared = F.size(F.array_intersect(F.filter(F.split("title", r"[^\p{L}]+"), lambda t: F.length(t) > 3), F.split(F.lower("raw"), r"[^\p{L}]+")))
    keyed = written(found.join(verdict, "raw_key").withColumn("titled", (F.col("points") >= 3) & (shared >= 2)).drop("raw", "title", "raw_key"), "hits")
    titled = keyed.where("titled").groupBy("key").agg(F.lit(3).alias("less"))
    keyed = keyed.join(titled, "key", "left").withColumn("points", F.col("points") - F.coalesce("less", F.lit(0)))
    per_doc = keyed.groupBy("doc_id", "source").agg(
        F.max(F.when(~F.col("is_filler"), F.col("points"))).alias("canned"),
        F.max(F.when(F.col("is_filler"), F.col("points"))).alias("filler"),
        F.max("is_machine").alias("is_machine"),
        F.max("is_open").alias("is_open"),
        F.count("strange").alias("strange"),
        F.sum("strange").alias("strange_words"),
    )
    flags = kept.groupBy("doc_id", "source").agg(F.max("is_placeholder").alias("_syntax"))
    met = flags.join(per_doc.withColumnsRenamed({"doc_id": "_d", "source": "_s"}), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    both = written(
        met.withColumns({"is_placeholder": F.col("_syntax") | F.coalesce("is_open", F.lit(False)), "is_machine": F.coalesce("is_machine", F.lit(False))}).drop("_d", "_s", "_syntax", "is_open"), "documents"
    )
    dummy = (F.col("strange") >= 2) & (F.col("strange_words") >= 8)
    sure = F.col("is_placeholder") | F.col("is_machine") | F.coalesce(F.greatest("canned", "filler") >= enough, F.lit(False)) | F.coalesce(dummy, F.lit(False))
    hosts = both.groupBy("source").agg(F.avg(sure.cast("double")).alias("share"))
    total = both.agg(F.avg(sure.cast("double")).alias("average"))
    suspect = hosts.join(F.broadcast(total), F.col("share") > F.col("average")).select(F.col("source").alias("_host"), F.lit(1).alias("suspect"))
    needed = F.lit(enough) - F.coalesce("suspect", F.lit(0))
    no = F.lit(False)
    out = both.join(suspect, F.col("source").eqNullSafe(F.col("_host")), "left").select(
        "doc_id",
        "is_placeholder",
        (F.coalesce(dummy, no) | F.coalesce(F.col("filler") >= needed, no)).alias("is_filler"),
        "is_machine",
        F.coalesce(F.col("canned") >= needed, no).alias("is_canned"),
    )
    names = ["is_placeholder", "is_filler", "is_machine", "is_canned"]
    return out.where(" or ".join(names)).groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
