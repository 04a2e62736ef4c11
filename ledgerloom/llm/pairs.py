"""Broken prompt and response pairs (problem 2).

Refusals: the first sentences of all responses, with the words of their prompt,
other figures and other names as slots, are clustered by MinHash over five-word
shingles: all pairs of a bucket are verified by a Jaccard similarity of 0.8 or
more, and the verified pairs are closed to connected components. A cluster that
recurs under prompts which are not related to each other, though it gives no value,
is a template of refusals, and so is one that recurs with recorded refusals. Every
response that begins with such a template and gives nothing new after it is a
refusal. Formulas of refusals name clusters too rare for that.
Emptiness, copies, languages and the end of the text label the rest. Complete
endings are learnt: a text without a final mark is complete if its last sentence
begins and ends as complete sentences of the corpus do.

Defined results: at most one defect for a pair, in the order empty, refusal, copy,
language, truncated; a null answer has no content; a null prompt can only be met
by an empty, refused or truncated answer; pairs of status clarification_needed
have none; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.once import once
from ledgerloom.operators.graph import components
from ledgerloom.session import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 2
#: Openings of a bucket that a task compares with all others.
BLOCK = 500
#: A template recurs under so many prompts. It needs so many words that are no slot to tell anything, and gives values where more
#: than this share of its records hold different ones.
RECURS, FIXED_WORDS, VALUES_SHARE = 3, 4, 0.5
#: Prompts are unrelated where they share at most so many times the words that two prompts of the corpus share.
UNRELATED = 1.5
#: The share of recorded refusals that makes a recurring template one, that of prompts which makes a word a common one, and
#: the letters of a word that can be what a prompt is about.
RECORDED_SHARE, COMMON_SHARE, TOPIC_LETTERS = 0.02, 0.02, 4

# Fixed values. Words for a missing value.
MISSING = "n/a|n\\.a\\.|na|null|none|nil|nan|undefined|missing|void|blank|empty|tbd|not applicable|no answer|no value|no data|\\(null\\)|<null>|<none>"
# Fixed values. Words before an answer that say nothing.
LEAD = (
    r"(?i)^[\s*_#>{\"'`]*(?:(?:(?:answer|response|reply|a|note)\b\s*[*_\"]*\s*[:\n]+[\s*_\"]*)|(?:in short|in brief|in summary|based on (?:the|this) [\w ]{3,30}|according to the [\w ]{3,30}"
    r"|unfortunately|sadly|regrettably|i'm sorry|i am sorry|sorry|i apologi[sz]e|thanks for asking|thank you for (?:asking|your question)|as far as i can tell|to be honest|having (?:read|reviewed|checked) [\w ]{3,40}"
    r"|after (?:checking|reading|reviewing) [\w ]{3,40})\s*[,;:.]\s*(?:but\s+|that\s+)?)+[\s*_]*"
)
# Where a sentence, or a clause that goes on from it, ends.
SEGMENT = r"(?<=[.!?。])\s+|(?<=。)|\n+|,\s+so\s+|\s+[-–—]\s+"
# Fixed values. Formulas of refusals, from their first word on.
REFUSAL = (
    r"i (?:can't|cannot|can not|could not|couldn't|am unable to|am not able to|won't be able to|will not be able to|must decline to|have to decline|am not in a position to) (?:help|answer|respond|find|assist|provide|determine|say|give|locate|comment|share|discuss|be of)\b.*",
    r"i (?:do not|don't) (?:have (?:access|enough|sufficient|any|the|that)|know)\b.*",
    r"i would rather not\b.*|i have to leave this\b.*|i must decline\b.*|i'd rather not\b.*|i have no (?:information|data|basis|access)\b.*",
    r"(?:it is )?(?:unable|not possible|impossible) to (?:determine|answer|say|establish|provide)\b.*",
    r"(?:the|this|these) (?:provided |supplied |given |retrieved |available |cited )*(?:context|documents?|excerpts?|passages?|chunks?|sources?|corpus|materials?|information|text)s? (?:does not|do not|doesn't|don't|did not) (?:contain|include|mention|provide|state|give|cover|say|allow|disclose|speak)\b.*",
    r"(?:the|these) (?:excerpts|passages|sources|documents|chunks|texts) (?:are silent|stop short|say nothing|give no)\b.*|the corpus gives me no\b.*",
    r"(?:this|that|it) (?:is not|isn't) (?:disclosed|contained|covered|mentioned|stated|included) in the (?:documents?|context|excerpts?|passages?|sources?|chunks?|material)\b.*|(?:this|that) (?:lies|falls|is) (?:beyond|outside)\b.*",
    r"(?:none of|nothing in) the (?:retrieved |supplied |cited |available )*(?:sources?|passages?|excerpts?|documents?|chunks?)\b.*|no (?:reliable )?(?:statement|answer) (?:is|can be) (?:possible|given)\b.*",
    r"an answer (?:can't|cannot) be (?:supported|given)\b.*|there (?:isn't|is not|is no) (?:enough|sufficient)? ?(?:evidence|information|basis|data)\b.*|(?:not enough|insufficient) (?:information|evidence|context|data)\b.*",
    r"as an ai\b.*|my (?:guidelines|instructions) (?:do not|don't)\b.*",
    r"(?:es tut mir leid|tut mir leid|leider)\b.*|das geht aus den (?:vorliegenden )?unterlagen .*nicht hervor\b.*|dazu kann ich (?:leider )?keine\b.*|diese frage kann ich .*nicht\b.*|die (?:vorliegenden )?unterlagen enthalten .*nicht\b.*",
    r"lo siento\b.*|no dispongo de\b.*|los documentos (?:facilitados )?no permiten\b.*|no puedo (?:responder|contestar|ayudar)\b.*",
    r"(?:je suis désolé|désolé)\b.*|cette information ne figure pas\b.*|les (?:extraits|documents) (?:fournis )?ne permettent pas\b.*|je ne (?:peux|suis) pas\b.*",
    r"(?:mi dispiace|spiacente)\b.*|non (?:posso|sono in grado di) (?:rispondere|aiutare)\b.*|(?:het spijt me|helaas)\b.*|ik kan (?:deze|die|daar) .*niet\b.*|申し訳.*|抱歉.*|对不起.*|很抱歉.*",
)
# Fixed values. Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was are were for that with on by as at from which this be it an not what how does did who under must has have where when its their each any after before than between",
    "de": "der die das und von den dem des im in ist nicht ein eine einer einem zu zum zur mit auf für sich auch wird bei rund lag damit wie hoch war sieht vor welche warum nach aus keine sofern seit über",
    "es": "el la los las de del en y que un una por con para se su al es son fueron más qué cuáles no desde salvo como hay este esta entre sobre",
    "fr": "le la les des du de et en un une est que qui pour dans sur au aux par pas ne cette ce son sa à quel quelle pourquoi était il elle sauf compter plus avec",
    "it": "il lo la i gli le di del della dei delle e che un una per con non è sono stati dal alla dalla nel nell al si come quali perché anche più ai salvo",
    "nl": "de het een van en in is dat op te voor met aan zijn niet bij uit naar door wordt vanaf hoe wat welke waarom was bedroeg ten over tenzij ook",
}
# Fixed values. Names of the languages a prompt can ask for.
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés|inglese|engels|英語|英语",
    "de": "german|deutsch|allemand|alemán|tedesco|duits|ドイツ語|德语",
    "es": "spanish|spanisch|espagnol|español|spagnolo|spaans|スペイン語|西班牙语",
    "fr": "french|französisch|français|francés|francese|frans|フランス語|法语",
    "it": "italian|italienisch|italien|italiano|italiaans|イタリア語|意大利语",
    "nl": "dutch|niederländisch|néerlandais|neerlandés|olandese|nederlands|オランダ語|荷兰语",
    "zh": "chinese|mandarin|chinesisch|chinois|chino|cinese|chinees|中国語|中文",
    "ja": "japanese|japanisch|japonais|japonés|giapponese|japans|日本語|日语",
}
# Fixed values. Words that end no sentence.
OPEN_WORDS = (
    "the a an of to and or in for by with which that from on than as at was were is are its their this after before because per between into whose if when while but our his "
    "der die das und von den dem des im ein eine einer zu zum zur mit auf für bei nach aus seit "
    "el la los las de del y que un una por con para su le les du et une est pour dans sur au aux par il lo gli di della dei e per con dal alla het een van op te voor aan"
).split()

LETTER = r"[\p{L}\p{N}]"
CJK = r"[぀-ヿ㐀-鿿]"


def readable(text: Column) -> Column:
    """Without invisible characters, with straight quotes."""
    return F.translate(F.regexp_replace(text, "[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]", ""), "’‘“” ", "''\"\" ")


def has_content(answer: Column) -> Column:
    """Whether something is left without markup, punctuation and words for a missing value."""
    bare = F.regexp_replace(F.coalesce(answer, F.lit("")), r"<[^<>]{0,200}>|&[a-z]{2,8};|```\w*", " ")
    word = F.regexp_replace(bare, r"^[^\p{L}\p{N}(<]+|[^\p{L}\p{N})>]+$", "")
    return bare.rlike(LETTER) & ~word.rlike(f"(?i)^(?:{MISSING})$")


def tokens(text: Column) -> Column:
    """Words in lower case; each Han or Kana character is one."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{CJK}|[\p{{L}}\p{{N}}&&[^぀-ヿ㐀-鿿]]+"), F.lit(0))


def core(answer: Column) -> Column:
    """The answer without the words before it that say nothing."""
    return F.trim(F.regexp_replace(answer, LEAD, ""))


def segments(said: Column) -> Column:
    """The sentences and clauses of an answer that hold a letter or a digit."""
    return F.filter(F.split(said, SEGMENT), lambda u: u.rlike(LETTER))


def template(segment: Column, asked: Column) -> Column:
    """Its words in lower case: those of the prompt (``asked``) as ¤, other figures as 0, other names as N; slots in a row count as one."""
    words = F.regexp_extract_all(segment, F.lit(rf"{CJK}|[\p{{L}}\p{{N}}&&[^぀-ヿ㐀-鿿]]+"), F.lit(0))
    slot = lambda w, i: F.when(F.array_contains(asked, F.lower(w)), "¤").when(w.rlike(r"^\p{N}"), "0").when((i > 0) & w.rlike(r"^\p{Lu}\p{L}"), "N").otherwise(F.lower(w))
    return F.regexp_replace(F.array_join(F.transform(words, slot), " "), r"([¤0N])(?: \1)+(?= |$)", "$1")


def common_words(prompts: DataFrame) -> DataFrame:
    """One row with the words that stand in many prompts; a share bounds their number by the length of a prompt."""
    counted = prompts.select(F.explode(F.concat(F.array(F.lit("")), "q")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = counted.where("w = ''").select(F.col("n").alias("total"))
    return counted.where("w != ''").crossJoin(F.broadcast(total)).where(F.col("n") >= COMMON_SHARE * F.col("total")).agg(F.collect_list("w").alias("common"))


def relatedness(prompts: DataFrame, group: list[str]) -> DataFrame:
    """(group, prompts, related): the words that two different prompts of a group share on average, as a share of the
    words of a prompt. It follows from the counts of the words, so no pair of prompts is made."""
    n = prompts.groupBy(*group).agg(F.count("*").alias("prompts"), F.sum(F.size("q")).alias("words"))
    c = F.col("c")
    shared = prompts.select(*group, F.explode("q").alias("w")).groupBy(*group, "w").agg(F.count("*").alias("c")).groupBy(*group).agg(F.sum(c * (c - 1)).alias("shared"))
    both = n.join(shared, group) if group else n.crossJoin(F.broadcast(shared))
    return both.select(*group, "prompts", F.try_divide(F.col("shared"), F.col("words") * (F.col("prompts") - 1)).alias("related"))


def language(text: Column, words: Column) -> Column:
    """Language of a text by its script, else by the function words among its distinct words; null where they don't tell."""
    hits = [F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, w.split())))).alias("n"), F.lit(k).alias("lang")) for k, w in FUNCTION_WORDS.items()]
    ranked = F.sort_array(F.array(*hits), asc=False)
    best, second = ranked[0], ranked[1]
    kana, han = F.regexp_count(text, F.lit(r"[぀-ヿ]")), F.regexp_count(text, F.lit(r"[㐀-鿿]"))
    latin = F.regexp_count(text, F.lit(r"\p{IsLatin}+"))
    return F.when((kana >= 2) & (kana + han > latin), "ja").when((han >= 3) & (han > latin), "zh").when((best["n"] >= 2) & (best["n"] > second["n"]), best["lang"])


def asked_language(prompt: Column) -> Column:
    """The languages that a prompt asks the answer to be in."""
    ask = r"(?i)(?:\b(?:in|auf|en|in het|op)\s+|\()(?:{n})\b|(?:{n})\s+(?:answer|reply|response|please)|(?:{n})(?:で|回答|作答)"
    return F.array_compact(F.array(*[F.when(prompt.rlike(ask.replace("{n}", f"(?:{names})")), F.lit(k)) for k, names in LANGUAGE_NAMES.items()]))


def is_copy(prompt: Column, answer: Column, q: Column, a: Column) -> Column:
    """Whether the answer, of distinct words ``a``, only repeats the prompt, of words ``q``, apart from a few words."""
    both = F.size(F.array_intersect(q, a))
    near = both / F.greatest(F.size(q) + F.size(a) - both, F.lit(1))
    after = F.regexp_extract(answer, r"(?s)[?？]([^?？]*)$", 1)
    after_prompt = F.regexp_extract(prompt, r"(?s)[?？]([^?？]*)$", 1)
    answered = F.size(F.array_except(tokens(after), tokens(after_prompt))) > 0
    asks = F.regexp_replace(answer, r"[\s\"'”’)*_:.!-]+$", "").rlike(r"[?？]$")
    same_start = F.arrays_overlap(F.slice(q, 1, 2), F.slice(a, 1, 2)) & F.array_contains(F.slice(a, 1, 4), F.get(q, F.lit(0)))
    return (F.size(q) > 0) & (near >= 0.7) & ~answered & (asks | same_start)


def _seeded(seed: int) -> Callable[[Column], Column]:
    return lambda shingle: F.xxhash64(shingle, F.lit(seed))


def clustered(templates: DataFrame) -> DataFrame:
    """(id, cluster) of the texts (id, opening) whose five-word shingles are alike: verified MinHash pairs, closed to components."""
    words = F.split("opening", " ")
    shingles = F.when(F.size(words) <= SHINGLE, F.array(F.col("opening"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    )
    templates = checkpointed(templates.select("id", F.array_distinct(F.transform(shingles, lambda s: F.xxhash64(s))).alias("shingles")))
    # A lambda of two parameters would be given the place of the shingle as its second one.
    mins = [F.array_min(F.transform("shingles", _seeded(i))) for i in range(BANDS * ROWS)]
    keys = F.array(*[F.xxhash64(F.lit(b), *mins[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])
    banded = checkpointed(templates.select("id", F.size("shingles").alias("size"), F.explode(F.array_distinct(keys)).alias("band")))
    # All pairs of a bucket, block by block, so that no task holds more than a block of a full bucket.
    buckets = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    held = banded.join(buckets, "band")
    left = held.select("band", F.pmod("id", "blocks").cast("int").alias("block"), F.col("id").alias("src"), F.col("size").alias("n_src"))
    right = held.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("dst"), F.col("size").alias("n_dst"))
    sizes = (F.col("n_src") >= SIMILARITY * F.col("n_dst")) & (F.col("n_dst") >= SIMILARITY * F.col("n_src"))
    pairs_met = left.join(right, ["band", "block"]).where((F.col("src") < F.col("dst")) & sizes).select("src", "dst").distinct()
    edges = (
        pairs_met.join(templates.select(F.col("id").alias("src"), "shingles"), "src")
        .join(templates.select(F.col("id").alias("dst"), F.col("shingles").alias("other")), "dst")
        .where(F.size(F.array_intersect("shingles", "other")) >= SIMILARITY * F.size(F.array_union("shingles", "other")))
        .select("src", "dst")
    )
    label = components(edges).withColumnRenamed("component", "cluster")
    return templates.select("id").join(label, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def refusal_openings(pairs: DataFrame) -> DataFrame:
    """opening of each template of refusals among pairs (opening, first, q, status, foreign).

    A cluster of openings is one where it recurs under prompts that are not related to each other and says nothing
    that differs from one to the next, or where it recurs and refusals are recorded under it. Answers in another language
    than their prompt tell nothing about its relation to others. Formulas of refusals name
    the clusters that are too rare to recur, or stand under prompts of one kind.
    """
    said = pairs.where("opening != ''").select("opening", "q", "foreign", F.xxhash64("first").alias("first"), F.xxhash64(F.array_join("q", " ")).alias("prompt"), F.coalesce(F.col("status") == "refused", F.lit(False)).cast("int").alias("refused"))
    templates = said.groupBy("opening").agg(
        F.count("*").alias("n"), F.sum("refused").alias("refused"), F.approx_count_distinct("prompt", 0.05).alias("prompts"), F.approx_count_distinct("first", 0.05).alias("fills")
    )
    templates = checkpointed(templates.withColumn("id", F.xxhash64("opening")))
    clusters = checkpointed(templates.join(clustered(templates), "id"))
    formula = "(?i)^(?:" + "|".join(f"(?:{r})" for r in REFUSAL) + ")$"
    fixed = F.size(F.filter(F.split("opening", " "), lambda w: ~w.isin("¤", "0", "N")))
    judged = clusters.groupBy("cluster").agg(
        F.sum("n").alias("n"),
        F.sum("refused").alias("refused"),
        F.sum("prompts").alias("prompts"),
        F.sum(F.when(F.col("opening").rlike(r"(?:^| )[0N](?: |$)"), F.col("fills")).otherwise(1)).alias("fills"),
        F.count("*").alias("members"),
        F.min(fixed).alias("fixed"),
        F.sum(_readable_formula(formula).cast("int")).alias("formulas"),
    )
    judged = checkpointed(judged)
    recurs = F.col("prompts") >= RECURS
    plain = judged.where(recurs & (F.col("fixed") >= FIXED_WORDS) & (F.col("fills") - F.col("members") < VALUES_SHARE * F.col("n")))
    meant = said.where("not foreign").join(clusters.select("opening", "cluster"), "opening").join(plain.select("cluster"), "cluster").groupBy("cluster", "prompt").agg(F.first("q").alias("q"))
    usual = relatedness(said.groupBy("prompt").agg(F.first("q").alias("q")), []).select(F.col("related").alias("usual"))
    apart = relatedness(meant, ["cluster"]).crossJoin(F.broadcast(usual)).where((F.col("prompts") >= RECURS) & (F.col("related") <= UNRELATED * F.col("usual"))).select("cluster")
    named = judged.where((recurs & (F.col("refused") >= 1) & (F.col("refused") >= RECORDED_SHARE * F.col("n"))) | (F.col("formulas") >= 0.5 * F.col("members"))).select("cluster")
    return clusters.join(apart.union(named).distinct(), "cluster").select("opening")


def _readable_formula(formula: str) -> Column:
    """Openings hold words only, so the formulas are met without their apostrophes."""
    return F.col("opening").rlike(formula.replace("n't", "n t").replace("i'm", "i m").replace("i'd", "i d"))


def _masked_words(sentence: Column) -> Column:
    """Words with names as N and figures as 0; Han and Kana characters stand alone."""
    masked = F.regexp_replace(sentence, r"\d[\d.,]*", "0")
    words = F.regexp_extract_all(masked, F.lit(rf"{CJK}|[\p{{L}}\p{{N}}&&[^぀-ヿ㐀-鿿]]+"), F.lit(0))
    return F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}"), F.lit("N")).otherwise(w))


def _shape(sentence: Column) -> tuple[Column, Column, Column]:
    words = _masked_words(sentence)
    n = F.size(words)
    return F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, F.greatest(n - 1, F.lit(1)), 2), " "), n


def truncated_pairs(rest: DataFrame) -> DataFrame:
    """(pair_table, pair_key) of the answers that break off, given (pair_table, pair_key, answer)."""
    marks = r"[\s\"'”’»*_`>\])}]*$"
    text = F.regexp_replace(core(F.col("answer")), r"[\s*_`]+$", "")
    pieces = F.filter(F.split(text, r"(?<=[.!?])\s+|(?<=[。！？])|\n+"), lambda s: s.rlike(LETTER))
    parts = checkpointed(once(rest, "pair_table", "pair_key", s=pieces).where(F.size("s") > 0).select("pair_table", "pair_key", "s"))
    done = r"[.!?。！？]" + marks
    whole = once(parts.select(F.explode("s").alias("u")).where(F.col("u").rlike(done) & ~F.col("u").rlike(r"(?:\.\.\.|…)" + marks)), shape=F.struct(*(c.alias(k) for c, k in zip(_shape(F.col("u")), ("first", "last", "n"), strict=True))))
    pairs = whole.select("shape.first", "shape.last").groupBy("first", "last").agg(F.count("*").alias("n_pair"))
    firsts = pairs.groupBy("first").agg(F.sum("n_pair").alias("n_first"))
    last = F.element_at("s", -1)
    trailing = r"(?:[\s\"'”’»*_`>\])}]|\.\.\.|…|(?<=\s)[-–—])+$"
    tail = parts.select("pair_table", "pair_key", last.alias("u"), F.size("s").alias("n_parts"))
    bare = F.regexp_replace("u", trailing, "")
    tail = once(tail, "pair_table", "pair_key", "u", "n_parts", bare=bare)
    tail = once(tail, "pair_table", "pair_key", "u", "n_parts", "bare", shape=F.struct(*(c.alias(k) for c, k in zip(_shape(F.col("bare")), ("first", "last", "n"), strict=True))))
    open_word = rf"(?i)(?:^|[^\p{{L}}'])(?:{'|'.join(sorted(set(OPEN_WORDS)))})$"
    bracket = F.regexp_count("bare", F.lit(r"\(")) > F.regexp_count("u", F.lit(r"\)"))
    cut = F.col("u").rlike(r"(?:\.\.\.|…|\s[-–—])" + marks) | F.col("bare").rlike(r"[,;:(（，、]$") | F.col("bare").rlike(open_word) | bracket
    ended = F.col("bare").rlike(r"[.!?。！？]$")
    dangling = F.regexp_replace("bare", r"\.+$", "").rlike(open_word)
    marker = (F.col("n_parts") > 1) & F.col("bare").rlike(r"^\d{1,2}\.$")
    tail = tail.select("pair_table", "pair_key", "n_parts", "shape.first", "shape.last", F.col("shape.n").alias("n"), cut.alias("cut"), ended.alias("ended"), dangling.alias("dangling"), marker.alias("marker"), F.col("bare").rlike(r"^\p{Lu}|^" + CJK).alias("upper"))
    known = tail.join(pairs, ["first", "last"], "left").join(firsts, "first", "left")
    n_pair, n_first = F.coalesce("n_pair", F.lit(0)), F.coalesce("n_first", F.lit(0))
    begun = ((F.col("n") >= 3) | (F.col("n_parts") > 1)) & (n_first >= 2) & (n_pair < F.greatest(F.lit(1), 0.002 * n_first))
    loose = (F.col("n_parts") > 1) & F.col("upper") & (n_pair == 0)
    return known.where(F.when(F.col("ended"), F.col("marker") | F.col("dangling") & (n_pair <= F.greatest(F.lit(1), 0.02 * n_first))).otherwise(F.col("cut") | begun | loose)).select("pair_table", "pair_key").distinct()


def all_pairs(judged: DataFrame, responses: DataFrame) -> DataFrame:
    """The distinct pairs of both tables under common names."""
    no = F.lit(None).cast("string")
    a = judged.select(F.lit("judge_calibration_v1").alias("pair_table"), F.col("case_id").alias("pair_key"), "input", F.col("actual_output").alias("answer"), no.alias("status"), no.alias("reason"))
    b = responses.select(F.lit("synthesis_responses").alias("pair_table"), F.col("response_id").cast("string").alias("pair_key"), "input", "answer", "status", "reason")
    return a.unionByName(b).where(F.col("pair_key").isNotNull()).distinct()


def broken_pairs(judged: DataFrame, responses: DataFrame) -> DataFrame:
    """(pair_table, pair_key, defect) of each defective pair."""
    pairs = all_pairs(judged, responses).where(F.coalesce("status", F.lit("")) != "clarification_needed")
    pairs = once(pairs, "pair_table", "pair_key", "status", input=readable(F.col("input")), answer=readable(F.col("answer")), reason=readable(F.col("reason")))
    label = r"(?i)^[\s\"'*_]*(?:(?:question|q|prompt|query|frage|pregunta|domanda|vraag|the question is|you asked)\s*:\s*)?"
    said, raw = F.col("said"), ("pair_table", "pair_key", "status", "input", "answer", "reason")
    pairs = once(pairs, *raw, said=core(F.col("answer")))
    pairs = once(pairs, *raw, "said", q=F.array_distinct(tokens(F.col("input"))), a=F.array_distinct(tokens(F.regexp_replace(said, label, ""))), content=has_content(said))
    prompts = pairs.select("q").where(F.size("q") > 0).distinct()
    pairs = pairs.withColumn("parts", F.when(F.col("content"), segments(said))).withColumn("reason_parts", segments(core(F.col("reason"))))
    pairs = pairs.crossJoin(F.broadcast(common_words(prompts))).withColumn("asked_for", F.filter(F.array_except("q", "common"), lambda w: (F.length(w) >= TOPIC_LETTERS) | w.rlike(r"^\p{N}")))
    names = F.regexp_like("input", F.lit("(?i)" + "|".join(LANGUAGE_NAMES.values())))
    facts = once(
        pairs,
        *raw,
        "content",
        "q",
        "asked_for",
        "parts",
        first=F.coalesce(F.get("parts", F.lit(0)), F.lit("")),
        opening=F.coalesce(template(F.get("parts", F.lit(0)), F.col("asked_for")), F.lit("")),
        reason_first=F.coalesce(F.get("reason_parts", F.lit(0)), F.lit("")),
        reason_opening=F.coalesce(template(F.get("reason_parts", F.lit(0)), F.col("asked_for")), F.lit("")),
        copied=F.coalesce(is_copy(F.col("input"), F.col("answer"), F.col("q"), F.col("a")), F.lit(False)),
        asked=language(F.col("input"), F.col("q")),
        spoken=language(said, F.col("a")),
        wanted=F.when(names, asked_language(F.col("input"))).otherwise(F.array()),
    )
    facts = checkpointed(facts)
    foreign = F.coalesce((F.col("spoken") != F.col("asked")) & ~F.array_contains("wanted", F.col("spoken")), F.lit(False))
    reasons = facts.where("status = 'refused'").select(F.col("reason_opening").alias("opening"), F.col("reason_first").alias("first"), "q", "status", F.lit(False).alias("foreign"))
    refusals = checkpointed(refusal_openings(facts.select("opening", "first", "q", "status", foreign.alias("foreign")).unionByName(reasons)).distinct())
    said = facts.join(refusals.select("opening", F.lit(True).alias("refuses")), "opening", "left")
    said = said.join(refusals.select(F.col("opening").alias("reason_opening"), F.lit(True).alias("reason_refuses")), "reason_opening", "left")
    # What follows a refusal must not give a figure or a name that the prompt has not.
    answers = F.exists(F.slice("parts", 2, 1 << 30), lambda u: template(u, F.col("asked_for")).rlike(r"(?:^| )[0N](?: |$)"))
    refused = (F.col("status") == "refused") | (~F.col("content") & F.col("reason_refuses")) | F.when(F.col("refuses"), ~answers)
    defect = F.when(F.coalesce(refused, F.lit(False)), "refusal").when(~F.col("content"), "empty").when(F.col("copied"), "copy").when(foreign, "language")
    first = checkpointed(said.select("pair_table", "pair_key", "answer", defect.alias("defect")))
    ends = truncated_pairs(first.where("defect is null"))
    return first.where("defect is not null").select("pair_table", "pair_key", "defect").union(ends.select("pair_table", "pair_key", F.lit("truncated"))).distinct()
