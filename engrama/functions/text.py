"""Text rules as column functions: tokens, entities, cues, entity types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cue words of the text features.
NEGATIONS = "not no never denied refuted isn't wasn't aren't weren't doesn't didn't disputes denies".split()
TEMPORAL = "was were until before after since during former current currently previously recently now then later earlier ago yesterday tomorrow".split()
MODALS = "may might allegedly reportedly rumor rumored said claims according stated announced".split()
#: Names that are taken for technologies.
TECH = (
    "faiss onnx scann redis kafka docker kubernetes react python rust java swift flutter pytorch tensorflow numpy pandas spark hadoop nginx postgres mysql sqlite graphql grpc oauth jwt html css "
    "api sdk ml ai gpu cpu ram ssd aws gcp claude openai anthropic gemini llama ollama"
).split()
#: First words of names that are no person's.
NOT_PERSONS = "project team company group department org the operation task plan system service app tool code server client api db database agent model version release build deploy config".split()
#: Relations of which a person has one at a time, and relations of taste.
IDENTITY = "birthday age lives_in works_at email phone full_name spouse hometown".split()
PREFERENCE = "prefers favorite likes dislikes".split()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}']+"), lambda x: x != "")


def alnum_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def contains_sequence(text: Column, entity: Column) -> Column:
    """Whether the entity's tokens occur in a row among the text's."""
    pad = lambda t: F.concat(F.lit(" "), F.array_join(tokens(t), " "), F.lit(" "))
    return (F.size(tokens(entity)) > 0) & F.contains(pad(text), pad(entity))


def proper_nouns(text: Column) -> Column:
    """Capitalised words in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:^|[ \n])([A-Z][a-z]+)")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def features(text: Column) -> Column:
    """Length, sentences, cue counts, and whether a text is compound or an assertion."""
    t = tokens(text)
    count = lambda words: F.size(F.filter(t, lambda x: x.isin(*words)))
    marks = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[.!?]"))
    return F.struct(
        F.length(F.coalesce(text, F.lit(""))).alias("chars"), F.size(t).alias("words"), marks.alias("sentences"), count(NEGATIONS).alias("negations"), count(TEMPORAL).alias("temporal"), count(MODALS).alias("modal"),
        (marks > 1).alias("compound"), ((count(MODALS) == 0) & ~F.endswith(F.coalesce(text, F.lit("")), F.lit("?"))).alias("assertion"),
    )


def entity_type(name: Column) -> Column:
    """tech by list or by capitals alone, person for two capitalised words that are neither tech nor a thing, else unknown."""
    whole = F.trim(name)
    words = F.split(whole, r"\s+")
    low = F.transform(words, F.lower)
    capitals = (F.length(whole) > 1) & whole.rlike(r"^[^\p{L}\p{Lu}]*(?:\p{Lu}[^\p{L}\p{Lu}]*)*$") & ~whole.rlike(r"[\p{Ll}\p{Lt}\p{Lo}\p{Lm}]")
    named = (F.size(words) == 2) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    return (
        F.when(F.lower(whole).isin(*TECH) | capitals, "tech")
        .when(named & F.get(low, F.lit(0)).isin(*NOT_PERSONS), "unknown")
        .when(named & F.exists(low, lambda w: w.isin(*TECH)), "tech")
        .when(named, "person")
        .otherwise("unknown")
    )


def conflict_type(relation: Column) -> Column:
    return F.when(relation.isin(*IDENTITY), "identity_fact").when(relation.isin(*PREFERENCE), "preference").otherwise("minor")


def is_date_like(token: Column) -> Column:
    return token.rlike(r"^\d{4}(-\d{1,2}){0,2}$|^\d{1,2}[/.]\d{1,2}([/.]\d{2,4})?$|^(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*$")


#: Endings that a stem for prefix search drops, the longest first; three letters at least are left.
ENDINGS = "ations ation tions ments tion sion ment ence ance ness ible able ful ous ive ary ery ory ing ble ity ish ed er ly al es s".split()
#: Verbs as base, past and the other forms; base and past stand for all the rest.
VERBS = (
    "grow grew grown growing|go went gone going|come came coming|run ran running|eat ate eaten eating|drink drank drunk drinking|write wrote written writing|read read reading|"
    "speak spoke spoken speaking|think thought thinking|buy bought buying|teach taught teaching|feel felt feeling|keep kept keeping|leave left leaving|meet met meeting|take took taken taking|"
    "give gave given giving|know knew known knowing|see saw seen seeing|begin began begun beginning|break broke broken breaking|drive drove driven driving|sing sang sung singing|"
    "swim swam swum swimming|choose chose chosen choosing|lose lost losing|win won winning|sleep slept sleeping|build built building|send sent sending|spend spent spending|fall fell fallen falling"
).split("|")


def stem(word: Column) -> Column:
    """The word without its ending, for prefix search; null for words of four letters or fewer, or without a known ending."""
    out = F.when(F.length(word) <= 4, F.lit(None).cast("string"))
    for s in ENDINGS:
        out = out.when((F.length(word) >= len(s) + 3) & F.endswith(word, F.lit(s)), F.substring(word, F.lit(1), F.length(word) - len(s)))
    return out


def verb_forms(word: Column) -> Column:
    """The other forms of an irregular verb given in its base or past form, else null."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for verb in VERBS:
        forms = verb.split()
        for form in dict.fromkeys(forms[:2]):
            out = out.when(word == form, F.array(*[F.lit(f) for f in dict.fromkeys(forms) if f != form]))
    return out


def cooldown_key(kind: Column, rids: Column) -> Column:
    return F.concat_ws(":", kind, F.array_join(F.array_sort(rids), ","))


def content_hash(parts: Column) -> Column:
    """Order-independent hash of an array of strings."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(parts)), "|"), 256)
