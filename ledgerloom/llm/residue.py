"""Template residue, filler and error pages (problem 8).

Placeholders: every span written like an unfilled variable is aligned with the
spans that stand between the same words in other records. Words between which
the records differ make an induced slot, and a slot that still holds a variable
name, a default or a blank is reported. A span that may be ordinary text and is
the same in nearly all distinct texts of its template is part of the text and is
not; a span that can only be a variable always is one. Quoted spans and sentences about
placeholders are no residue.

Filler: words of blind text, words and phrases that repeat themselves, sentences
that stand three times in a row wherever the corpus holds them, and fixed sentences
that the corpus mostly holds beside those.

Error pages and script notices: known sentences are taken out of a text, navigation
after them; further sentences count as a page's template when they recur in texts
that hold nothing else. A text of which nothing is left is reported.

Defined results: null, empty and blank texts give no row; a text of several
kinds gets the first of placeholder, filler, error_page, script_notice; repeated
rows give one row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.once import once, spread
from ledgerloom.llm import slots
from ledgerloom.session import checkpointed

QUOTES = "\"'`“”„‟‘’‚«»‹›"
# Fixed values. Spans that name a variable, hold a default or a failed fill.
STRONG = (
    r"\{\{[^{}\n]+\}\}",
    r"\$\{[^{}\n]+\}",
    r"\{%[^%\n]+%\}",
    r"<%=?[^%\n]+%>",
    r"%\([A-Za-z_]\w*\)[sdif]",
    r"\[\[[^\[\]\n]+\]\]",
    r"<<\s?[A-Za-z][\w .-]{0,60}>>",
    r"«[A-Za-z][A-Za-z0-9_]{1,40}»",
    r"@@[A-Za-z]\w*@@",
    r"%%[A-Za-z]\w*%%",
    r"(?<![\w&])#[A-Z][A-Z0-9_]+#",
    r"(?<!\w)__[A-Za-z][A-Za-z0-9_]*?__(?!\w)",
    r"&lt;[A-Za-z][\w ]{1,60}&gt;",
    r"<(?i:insert|exact|enter|your|add|fill|name|specify)\b[^<>\n]{0,60}>",
    r"\[(?i:insert|tbd|tbc|to be (?:completed|determined|confirmed|inserted|provided)|enter|your|fill in|add|specify)\b[^\[\]\n]{0,60}\]",
    r"\[[^\[\]\n]{1,60}\b(?iu:einf(?:ü|u|ue)gen|eintragen|ins[ée]rer|insertar|inserire|invullen)\]",
    r"\[object Object\]",
    r"\[[_●•.…\s]{1,40}(?<!\s)\]",
    r"#(?:REF|VALUE|NAME|DIV/0|NULL)[!?]",
    r"\bInvalid Date\b",
)
# Fixed values. Spans that may also be ordinary text.
WEAK = (
    r"(?<![\w{$])\{(?:\d{1,2}|[A-Za-z_][A-Za-z0-9_]{0,40})\}(?!\})",
    r"(?<!\[)\[[A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*){0,4}\](?!\])",
    r"<[a-z]+(?:[ _][a-z]+){1,5}>",
    r"(?<![\w-])undefined(?![\w-])",
    r"(?<![\w/])(?:XX|DD|MM)[/.](?:XX|DD|MM)[/.](?:20)?(?:XX|YY)(?:XX|YY)?(?!\w)",
    r"(?<![\w\"':])(?:NaN|null)(?![\w\"'])",
)
# Fixed values. Names, defaults and blanks that are residue only in a slot that other records fill.
BARE = (
    r"(?<![\w/.@-])[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+(?![\w/@-])",
    r"(?<![\w/.@-])[a-z]{2,}(?:[A-Z][a-z0-9]+)+(?![\w/@-])",
    r"(?<!\w)[A-Z]{3,}(?: [A-Z]{2,}){0,3} (?:NAME|DATE|AMOUNT|NUMBER|ADDRESS|YEAR|TITLE|VALUE|CITY|STATE|PARTY)(?!\w)",
    r"\[[A-Za-z][\w .:/-]{0,60}\]|<[A-Za-z][\w .:/-]{0,60}>|\{[A-Za-z][\w .:/-]{0,60}\}",
    r"(?<!\w)(?:(?:[Aa]cme|ACME|Foo|Example|Sample|Your|My|Test|Dummy) (?:Corp(?:oration)?|Inc|Company|Co|Ltd|LLC|Name)|(?:John|Jane) (?:Doe|Smith|Q\. Public)|Foo ?[Bb]ar|Company Name|First Last)(?!\w)",
    r"(?<![\d/.-])(?:0?1/0?1/(?:1900|1970|0001)|(?:1900|1970|0001)-01-01|00/00/0000|0000-00-00|99/99/9999|123 Main St(?:reet)?)(?![\d/-])",
    r"(?<![\w/])(?:N/A|n/a|TBD|TBC|None|NULL|nil|nan|X{3,}|x{4,}|\?{3,})(?![\w/])",
    r"_{3,}|\.{4,}|…{2,}|-{3,}|\(\s*\)|\[\s*\]|(?<=\S) {2,}(?=\S)|(?<=\w) (?=[,;.](?:\s|$))",
)
# Fixed values. Texts with wide spaces or letters of random case throughout are no sign of a blank or a name.
NOISE = ((r" +", r"\S {2,}\S"), (r"[a-z]+(?:[A-Z][a-z0-9]+)+", r"[A-Z]{2}[a-z]|[a-z][A-Z]{2}|[A-Z][a-z][A-Z]"))
LITERAL = r"(?i)^\[(?:reserved|sic|signatures?.*|intentionally.*|omitted|redacted|table of contents|note|notes|graphic|image|logo|seal|page.*|end.*|remainder.*|emphasis.*|laughter|inaudible|applause)\]$"
TALK = r"(?i)\b(?:slots?|placeholders?|templates?|marks?|such as|for example|e\.g\.|for instance|so-called|variables?|syntax|escap\w+|literal\w*|docstring|regex|drafts?|call(?:ed|s)|written as|notation|jinja\w*|mustache|handlebars|braces|brackets|render\w*|in (?:the|a|this|that) (?:field|column)s?|keywords?)\b"

# Fixed values. Filler: words of the usual blind text, and sentences that hold a place.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur "
    "sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum conse tempus erat vivit nunc quam porta arcu libra fermo mora unda "
    "pars vetra vivamus vestibulum pellentesque mauris aenean nullam curabitur fusce maecenas phasellus praesent donec integer nam cras morbi sem leo orci justo"
).split()
FILLER = (
    r"placeholder (?:paragraph|text|copy|content|sentence)s? (?:for|goes|here|to)\b",
    r"this is (?:only |just |merely )?(?:dummy|sample|placeholder|filler|blind|example) (?:copy|text|content)",
    r"dies ist ein (?:blind|platzhalter|muster|füll)text",
    r"(?:texto de relleno|texte de remplacement|testo segnaposto|tekst als vulling|opvultekst|faux[ -]texte)\b",
    r"(?:^|[.!?:\n]\s*)(?:your|the) (?:text|description|content|title|caption|introduction|story) (?:goes|will (?:appear|go|be placed)) here\b",
    r"(?:^|[.!?:\n]\s*)(?:text|content|copy|description|title|caption|heading) (?:goes|to go) here\b",
    r"(?:^|[.!?:\n]\s*)(?:content|text|more information|details?) coming soon\s*(?:[.!]|$|\n)",
    r"(?:^|[.!?:\n]\s*)sample text\s*(?:[.!]|$|\n)",
    r"replace this (?:paragraph|text|sentence|copy|content) with your own",
    r"(?:add|enter|put|place|insert) (?:a |an |your |some )?(?:short |brief |own )?(?:introduction|text|description|summary|paragraph|content|words) (?:to your \w+ |of your \w+ )?(?:at this point|here|in this box|in this space)",
)
LOREM_WORD = r"\b(?:lorem|ipsum|dolor|amet|elit|vetra|fermo|conse)\b"
NAVIGATION = r"^[^\p{L}\p{N}]*(?:[\p{L}\p{N}]+[^\p{L}\p{N}.!?;,]*){0,4}[.!?]?\s*$"
REPEATED = r"(?<![\p{L}\p{N}])(?:(\p{L}{2,20}+)(?:\s++\1){7}|(\p{L}{3,20}+\s\p{L}{3,20}+)(?:\s\2){2})(?![\p{L}\p{N}])"

# Fixed values. Sentences of pages. THING stands for what a page speaks of.
THING = r"\b(?:the|this|your|our|that)(?:\s+[\w'-]+){1,4}?"
ERROR = (
    r"(?:error\s*:?\s*|http(?:/\d\.\d)?\s*(?:error\s*)?-?\s*|erreur\s+|fehler\s+|errore?\s+)?(?<!\d)[45]\d\d\s*[-–:|]?\s*(?:error|page |not found|forbidden|internal server error|service (?:temporarily )?unavailable|bad gateway|bad request|gateway time-?out|too many requests|unauthorized|gone|request time-?out|access denied|method not allowed|document introuvable)\w*",
    r"\b(?:http|error|erreur|fehler)\s*(?:status\s*)?:?\s*[45]\d\d(?:\s*[-–:]\s*[\w ]{3,40})?(?=[.!\n]|$)",
    r"bad gateway(?: \(\d+\))?|gateway time-?out|(?:404 )?not found(?=[.!\s]|$)|(?:403 )?forbidden(?=[.!\s]|$)|internal server error|service unavailable|too many requests|request blocked|request rejected",
    r"(?:404 )?page not found|page introuvable|seite nicht gefunden|p[áa]gina no encontrada|pagina non trovata|pagina niet gevonden|access denied|zugriff verweigert|acc[èe]s refus[ée]|acceso denegado",
    r"die angeforderte seite wurde nicht gefunden|erreur \d+ : document introuvable|la p[áa]gina (?:solicitada )?no (?:existe|se ha encontrado|está disponible)|la page demand[ée]e (?:est introuvable|n'existe pas)|el servicio no está disponible(?: en este momento)?|der (?:server|dienst) ist (?:derzeit|zurzeit|momentan) nicht (?:erreichbar|verfügbar)|le service est (?:temporairement )?indisponible",
    rf"{THING}\s+(?:could not be (?:found|located|served|loaded|displayed|reached|opened|completed|retrieved|processed)|cannot be (?:found|displayed|reached|loaded|opened|shown|served)|can't be (?:found|reached|displayed)|timed out|is (?:temporarily |currently |no longer )?(?:unavailable|not available|available only)|has (?:been )?(?:moved or removed|moved|removed|expired|been deleted)|returned (?:status|error|code)\s*\d*|is (?:open|available|restricted|limited|visible) (?:only )?to (?:[\w-]+ )?(?:users|members|subscribers)(?: only)?|was refused|was not found|failed to load|failed|is busy|does not exist|took too long|was blocked|has been (?:limited|blocked|denied|suspended))(?:\s+(?:on this server|by the remote host|within the time limit|at the moment|for you|to respond|at this time|with status \d+|from this address))?",
    rf"{THING} you (?:asked for|requested|followed|are looking for|were looking for)(?:\s+[\w'-]+){{1,10}}?\s+(?:server|removed|moved|found|located|unavailable|host|limit|out|displayed|only|load|\d+|moment|exist)(?: or the \w+ may have been \w+)?",
    r"the link you followed may be broken[^.\n]{0,60}",
    r"an unexpected (?:condition|error) (?:prevented|occurred|has occurred)[^.\n]{0,60}",
    r"you (?:do not|don't) have (?:permission|access|the rights?) to [^.\n]{2,40}",
    r"upstream connect error[^\n]{0,120}?(?:reset reason: ?[\w ]+|$)",
    r"\{\s*[\"“”]error[\"“”][^\n]{0,200}\}+",
    r"<error>[^\n]{0,300}?</error>",
    r"error \d+: could not [^\n]{2,80}?(?:\(\d+ attempts?\)|$|\.|\n)",
    r"traceback \(most recent call last\):|file [\"“”][^\"“”\n]{1,80}[\"“”], line \d+(?:, in [<>\w]+)?|\b[a-z]\w*(?:error|exception)(?:: [^\n]{0,80}?)?(?=\n|$)",
    r"segmentation fault(?: \(core dumped\))?|fatal error:[^\n]{0,100}|panic: [^\n]{0,100}|exception in thread [^\n]{0,100}|null pointer exception|stack overflow",
    r"(?:your )?session (?:has )?expired|rate limit (?:was |has been )?exceeded|the service is busy[^.\n]{0,30}|connection (?:was )?(?:refused|reset|closed)[^.\n]{0,40}|(?:scheduled|under) maintenance",
    r"(?:^|\n)\s*(?:oops|whoops)\b[!.…]*|something went wrong|an error (?:has )?occurred|sorry, (?:an error|something)[^.\n]{0,40}",
)
NOTICE = (
    r"(?:to (?:continue|proceed|go on)[ ,]+)?(?:please )?(?:enable|activate|turn on|allow|switch on|permit) (?:java ?script|scripts?|scripting|active scripts?)(?: and cookies)?(?: (?:to|in|for|and|on)\b[^.\n]{0,60}|, then [^.\n]{0,60})?",
    r"(?:\bchecking [^.\n;]{0,30};\s*)?(?:java ?script|scripts?|scripting) (?:must|needs? to|ha(?:s|ve) to) be (?:allowed|enabled|permitted|active|switched on)[^.\n]{0,60}",
    r"\ban? (?:[\w-]+ )?browser with (?:[\w-]+ ){0,2}(?:java ?script|scripts?|scripting)(?: [\w-]+)? is (?:needed|required)[^.\n]{0,60}",
    r"(?:bitte )?aktivieren sie java ?script[^.\n]{0,60}|veuillez activer java ?script[^.\n]{0,60}|(?:por favor,? )?activ(?:e|ar) java ?script[^.\n]{0,60}|(?:si prega di )?(?:abilitare|attivare|attiva) java ?script[^.\n]{0,60}|schakel java ?script in[^.\n]{0,60}",
    r"java ?script (?:is|must be|has to be|needs to be) (?:required|disabled|enabled|turned on|turned off|needed|off)[^.\n]{0,50}",
    r"you must have java ?script[^.\n]{0,60}|you need (?:to enable )?java ?script[^.\n]{0,60}",
    r"your browser does(?: not|n't) support (?:java ?)?script(?:ing|s)?[^.\n]{0,50}|your browser has (?:java ?)?script(?:ing|s)? (?:disabled|turned off)[^.\n]{0,40}",
    r"we're sorry,? but [^.\n]{0,40}?does(?:n't| not) work properly without java ?script[^.\n]{0,30}",
    rf"(?:{THING})\s+(?:requires?|needs?|relies on|depends on|only works with|will not (?:load|work|run) without|cannot (?:run|load|start|work|be shown) without|does not (?:load|work|run) without)\s+(?:active |client-side |browser )?(?:java ?script|script support|scripting|scripts?\b)(?: and cookies| support|, which is switched off| enabled| to run(?:, but they are switched off in your browser)?)?",
)
CHROME = (
    r"reload the page(?: afterwards)?|loading(?:\.\.\.|…)?|instructions for the most common browsers[^.\n]{0,60}|if you use a blocker[^.\n]{0,60}",
    r"return to the home page[^.\n]{0,40}|please (?:try again|sign in)[^.\n]{0,40}|try again later|if the problem persists[^.\n]{0,80}|reference number:? [\d.]+|(?:incident|request|ray) id:? [\w-]+",
    r"vuelva a intentarlo[^.\n]{0,30}|bitte versuchen sie es[^.\n]{0,30}|veuillez r[ée]essayer[^.\n]{0,30}|riprovare[^.\n]{0,30}|</?noscript>|</?(?:html|body|h1|p|div|title|center|hr|br)[^>]{0,40}>",
)
# Cheap tests that every candidate passes, so that few texts meet the patterns above.
SPAN_HINT = r"[{\[<«]|@@|%%|%\(|#[A-Z]|__[A-Za-z]|&lt;|undefined|XX[/.]|DD[/.]|MM[/.]|NaN|null|Invalid"
FILLER_HINT = (
    "placeholder", "dummy", "sample", "filler", "blind", "platzhalter", "muster", "f\u00fclltext", "relleno", "remplacement", "segnaposto", "vulling", "vultekst", "faux", " here", "coming soon", "replace this",
    "at this point", "in this box", "in this space", "example",
)
LOREM_HINT = ("lorem", "ipsum", "dolor", "vetra", "fermo", "conse ")
PAGE_WORDS = (
    " script", "\nscript", ">script", "javascript", "java script", "scripting", "error", "erreur", "fehler", "gateway", "timeout", "time-out", "timed out", "forbidden", "verboten", "access denied", "verweigert", "refus",
    "denegado", "errore", "not found", "introuvable", "nicht gefunden", "no encontrada", "non trovata", "niet gevonden", "could not be", "cannot be", "can't be", "unavailable", "not available", "disponible", "derzeit nicht",
    "moved or removed", "has been moved", "has moved", "available only", "has removed", "returned status", "returned error", "returned code", "failed", "has expired", "been deleted", "was not found", "was blocked", "has been limited", "has been denied", "has been suspended", "open to", "restricted to", "limited to", "visible to", "available to", "only to", "you asked for", "you requested", "you followed", "looking for", "request blocked", "request rejected", "too many requests", "http", "went wrong", "traceback", "exception", "upstream",
    "does not exist", "n'existe pas", "no existe", "no se ha encontrado", "zurzeit nicht", "momentan nicht", "no longer", "took too long", "null pointer", "stack overflow", "fatal", "too many", "unauthorized", "bad request", "method not", "oops", "whoops", "service is", "your session", "have permission to", "may be broken", "unexpected", "segmentation", "panic:", "session", "rate limit", "busy", "connection", "maintenance",
)
#: A sentence belongs to pages, or to filler, where so many texts and this share of all texts with it hold it beside known ones.
SUPPORT, SUPPORT_SHARE = 5, 0.8
#: A longer sentence is no entry of a navigation and none of its usual sentences.
LINE_CHARS = 120
#: A text of recurring page sentences alone is a page where this share of all texts with them holds a known one.
PAGE_SHARE = 0.34
#: A sentence that stands three times in a row is filler where it does so in so many texts and this share of all texts with it;
#: one that stands beside filler where it does so in this share.
REPEAT_TEXTS, REPEAT_SHARE, BESIDE_SHARE = 3, 0.5, 0.5
#: Characters around a span that its own sentence is sought in.
CONTEXT = 200
#: A span that may be ordinary text is text where its form fills this share of the distinct texts of its template; fewer texts tell nothing.
LITERAL_SHARE, LITERAL_TEXTS = 0.9, 3
#: A slot is induced where this share of the distinct texts of a template hold values, and so many different ones.
FILLED_SHARE, FILLED_VALUES = 0.5, 2


def plain(text: Column) -> Column:
    """Without invisible characters, and with one kind of space, quote and line end."""
    t = F.regexp_replace(text, "[\\u00ad\\u200b-\\u200f\\u2060\\ufeff\\ufe0e\\ufe0f]", "")
    t = F.translate(t, "\u00a0\u2007\u2009\u202f\u3000\u2019\u2018\u201c\u201d\u2011", "     ''\"\"-")
    t = F.replace(F.replace(t, F.lit("\ufb01"), F.lit("fi")), F.lit("\ufb02"), F.lit("fl"))
    t = F.regexp_replace(t, "\\r\\n?|[\\u0085\\u2028\\u2029\\u000b\\u000c]", "\n")
    odd = "[\\u00ad\\u200b-\\u200f\\u2060\\ufeff\\ufe0e\\ufe0f\\u00a0\\u2007\\u2009\\u202f\\u3000\\u2018\\u2019\\u201c\\u201d\\u2011\\ufb01\\ufb02\\r\\u0085\\u2028\\u2029\\u000b\\u000c]"
    return F.when(text.rlike(odd), t).otherwise(text)


def _any(patterns: tuple[str, ...]) -> str:
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def readable(documents: DataFrame) -> DataFrame:
    """(doc_id, t): the texts that hold anything."""
    return once(spread(documents.select("doc_id", "text")), "doc_id", t=plain(F.col("text"))).where(F.col("t").rlike(r"\S"))


def sentences(low: Column) -> Column:
    """Sentences, lines and entries of lists of a text in lower case."""
    return F.filter(F.transform(F.split(low, r"(?<=[.!?])\s+|\n+|\s*[|>·•]\s*"), F.trim), lambda u: u.rlike(r"[\p{L}\p{N}]"))


def hashes(units: Column) -> Column:
    """Hashes of the sentences that are no navigation, with figures as 0."""
    content = F.filter(units, lambda u: (F.length(u) > LINE_CHARS) | ~u.rlike(NAVIGATION) & ~u.rlike(f"^{_any(CHROME)}[.!]?$"))
    return F.transform(content, lambda u: F.xxhash64(F.regexp_replace(u, r"\d+", "0")))


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, t, low, span, bare, fill, page, repeats, units): every text with hashes of its sentences and of those that
    stand three times in a row, read once; t and low only where a cheap test tells that a pattern may be met."""
    docs = readable(documents)
    docs = once(docs, "doc_id", "t", low=F.lower("t"))
    docs = once(docs, "doc_id", "t", "low", said=sentences(F.col("low")))
    low, said = F.col("low"), F.col("said")
    often = F.size(said) - F.size(F.array_distinct(said)) >= 2
    again = F.when(often, F.filter(said, lambda u, i: (i > 1) & (u == F.get(said, i - 1)) & (u == F.get(said, i - 2)))).otherwise(F.array().cast("array<string>"))
    tests = {
        "span": F.col("t").rlike(SPAN_HINT),
        "bare": _matches(F.col("t"), BARE),
        "fill": _has(low, FILLER_HINT + LOREM_HINT) & low.rlike(_any(FILLER + (LOREM_WORD,))) | low.rlike(REPEATED),
        "page": (_has(low, PAGE_WORDS) | low.startswith("script") | low.rlike(r"^\s*[45]\d\d\b|\n\s*[45]\d\d\b")) & _matches(low, NOTICE + ERROR),
        "repeats": F.array_distinct(hashes(again)),
        "units": F.array_distinct(hashes(said)),
    }
    met = F.expr("span or bare or fill or page")
    return checkpointed(once(docs, "doc_id", "t", "low", **tests).select("doc_id", *(F.when(met, F.col(c)).alias(c) for c in ("t", "low")), *tests))


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found; one by one they are searched faster than as a choice."""
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def _has(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def placeholder_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, body, span, bare, strong, left, template): each candidate span with its text and the words around it."""
    span = _any(STRONG + WEAK)
    t = F.when(F.col("span"), F.regexp_replace("t", f"({span})", "\ue000$1\ue001")).otherwise(F.col("t"))
    marked = once(docs.where("span or bare"), "doc_id", "bare", body=F.xxhash64("t"), t=t).where(F.col("bare") | F.contains("t", F.lit("\ue000")))
    found = slots.candidates(marked.select("doc_id", "body", "t"), _any(BARE), CONTEXT, NOISE)
    left, right = F.col("before"), F.col("after")
    quoted = left.rlike(f"[{QUOTES}]\\s?$") & right.rlike(f"^\\s?[{QUOTES}]")
    found = found.where(~quoted & ~F.concat(left, F.lit(" "), right).rlike(TALK) & ~F.col("span").rlike(LITERAL) & (~F.col("bare") | F.col("left").isNotNull()))
    return checkpointed(found.select("doc_id", "body", "span", "bare", (~F.col("bare") & F.col("span").rlike(f"^{_any(STRONG)}$")).alias("strong"), "left", "template").distinct())


def unfilled(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id of the texts with an unfilled slot, by aligning the records of each template."""
    spans = placeholder_spans(docs)
    texts = readable(documents).select(F.xxhash64("t").alias("body"), "t")
    open_ = spans.where("not strong")
    aligned = slots.values(texts, slots.key_bits(open_)).distinct()
    aligned = aligned.join(open_.select("template").distinct(), "template", "left_semi").join(spans.select("template", "body").distinct(), ["template", "body"], "left_anti")
    filled = aligned.groupBy("template", "value").agg(F.count("*").alias("texts")).groupBy("template").agg(F.sum("texts").alias("others"), F.sum(F.when(F.col("value") != 0, F.col("texts"))).alias("held"), F.count_if(F.col("value") != 0).alias("values"))
    forms = spans.select("template", "span", "body").distinct().groupBy("template", "span").agg(F.count("*").alias("texts"))
    records = forms.groupBy("template").agg(F.sum("texts").alias("records")).join(filled, "template", "left")
    n = F.col("records") + F.coalesce("others", F.lit(0))
    literal = (F.col("texts") >= LITERAL_TEXTS) & (F.col("texts") >= LITERAL_SHARE * n)
    induced = (F.coalesce("values", F.lit(0)) >= FILLED_VALUES) & (F.coalesce("held", F.lit(0)) >= FILLED_SHARE * n)
    judged = forms.join(records, "template").select("template", "span", literal.alias("literal"), induced.alias("induced"))
    kept = open_.join(judged, ["template", "span"]).where(F.when(F.col("bare"), F.col("induced")).otherwise(~F.col("literal")))
    return spans.where("strong").select("doc_id").union(kept.select("doc_id")).distinct()


def counted(docs: DataFrame) -> DataFrame:
    """(unit, texts, repeats): the texts that hold each sentence, and those in which it stands three times in a row."""
    held = docs.select(F.explode("units").alias("unit"), "repeats")
    return held.groupBy("unit").agg(F.count("*").alias("texts"), F.count_if(F.array_contains("repeats", F.col("unit"))).alias("repeats"))


def holding(docs: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id of the texts with one of the sentences ``units``."""
    return docs.select("doc_id", F.explode("units").alias("unit")).join(units.select("unit"), "unit", "left_semi").select("doc_id").distinct()


def filler(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id of the texts with filler in place of content: words and sentences of blind text, sentences that repeat
    themselves wherever they stand, and fixed sentences that stand beside those."""
    low, some = F.col("low"), docs.where("fill")
    words = F.regexp_extract_all(F.lower("u"), F.lit(r"\p{L}+"), F.lit(0))
    known = F.expr(f"size(array_intersect(w, array({', '.join(repr(w) for w in LOREM)})))")
    units = some.where(low.rlike(LOREM_WORD)).select("doc_id", F.explode(F.split("t", r"(?<=[.!?])\s+|\n+")).alias("u")).where(F.lower("u").rlike(LOREM_WORD))
    latin = units.select("doc_id", words.alias("w")).where((F.size("w") >= 4) & (known >= 0.8 * F.size(F.array_distinct("w")))).select("doc_id")
    held = some.where(low.rlike(_any(FILLER)) | low.rlike(REPEATED)).select("doc_id")
    echo = counts.where((F.col("repeats") >= REPEAT_TEXTS) & (F.col("repeats") >= REPEAT_SHARE * F.col("texts")))
    first = checkpointed(held.union(latin).union(holding(docs, echo)).distinct())
    beside = docs.join(first, "doc_id", "left_semi").select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("beside")).where(F.col("beside") >= SUPPORT)
    fixed = beside.join(counts, "unit").where(F.col("beside") >= BESIDE_SHARE * F.col("texts"))
    return first.union(holding(docs, fixed)).distinct()


def pages(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, kind) of the texts that are nothing but an error or a script notice: known sentences, and those
    that recur in texts which hold nothing else."""
    error, notice, chrome = (_any(p) for p in (ERROR, NOTICE, CHROME))
    rest = F.regexp_replace(F.col("low"), notice, " ¤n¤ \n")
    rest = F.regexp_replace(rest, error, " ¤e¤ \n")
    rest = F.regexp_replace(rest, chrome, "\n")
    seen = once(docs.where("page"), "doc_id", rest=rest).where(F.col("rest").rlike("¤[en]¤"))
    kind = F.when(F.col("rest").contains("¤e¤"), "error_page").otherwise("script_notice")
    seen = checkpointed(seen.select("doc_id", kind.alias("kind"), F.array_distinct(hashes(sentences(F.regexp_replace("rest", r"¤[en]¤", "\n")))).alias("unknown")).distinct())
    alone = F.col("alone").cast("int")
    support = (
        seen.select("kind", F.explode("unknown").alias("unit"), (F.size("unknown") == 1).alias("alone"))
        .groupBy("unit")
        .agg(F.sum(alone).alias("support"), F.count("*").alias("n"), F.min_by("kind", F.struct(~F.col("alone"), "kind")).alias("kind"))
        .where((F.col("support") >= SUPPORT) & (F.col("support") >= SUPPORT_SHARE * F.col("n")))
    )
    support = checkpointed(support)
    content = seen.select("doc_id", F.explode("unknown").alias("unit")).join(support, "unit", "left_anti")
    # Texts without a known sentence that hold nothing but sentences of pages, where these stand beside a known one more often than without.
    rows = docs.join(seen, "doc_id", "left_anti").select("doc_id", F.size("units").alias("n_units"), F.explode("units").alias("unit"))
    rare = support.join(counts, "unit").where(F.col("n") >= PAGE_SHARE * F.col("texts")).select("unit", "kind")
    whole = rows.join(rare, "unit").groupBy("doc_id", "n_units").agg(F.count("*").alias("n"), F.min("kind").alias("kind")).where("n = n_units")
    return seen.select("doc_id", "kind").join(content, "doc_id", "left_anti").union(whole.select("doc_id", "kind")).distinct()


def find_residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of the texts with residue; one kind for each text."""
    docs = candidates(documents)
    counts = checkpointed(counted(docs).where(F.col("texts") >= REPEAT_TEXTS))
    order = {"placeholder": 1, "filler": 2, "error_page": 3, "script_notice": 4}
    kinds = (
        unfilled(docs, documents)
        .select("doc_id", F.lit("placeholder").alias("kind"))
        .unionByName(filler(docs, counts).select("doc_id", F.lit("filler").alias("kind")))
        .unionByName(pages(docs, counts))
    )
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("kind")]
    return kinds.groupBy("doc_id").agg(F.min_by("kind", rank).alias("kind"))
