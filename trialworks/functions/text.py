"""Column expressions over copy: normalisers, tokens, surface features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the feature definitions.
STOPWORDS = """a an the and or but if then than that this these those of to in on at for with from by as is are was were be
been being am do does did doing have has had having i you he she it we they me him her us them my your his its our their
not no nor so too very can will just don should now""".split()
WH_WORDS = "what why how who when where which whose whom".split()
DEMONSTRATIVES = "this that these those it".split()
SECOND_PERSON = "you your yours yourself yourselves".split()
FIRST_PERSON = "i me my mine we us our ours".split()
NEGATIONS = """no not never none nothing nobody nowhere neither nor cannot cant dont doesnt didnt wont wouldnt shouldnt couldnt
isnt arent wasnt werent havent hasnt hadnt without stop quit avoid""".split()
CONSENSUS = """everyone everybody all most many people others nation world americans women men parents kids everyone's majority
millions thousands""".split()
THIRD_SINGULAR = "he she her him his hers herself himself".split()
COLLECTIVE = """they them their theirs themselves people everyone everybody all most many others society americans women men
parents kids students workers citizens humans humanity nations countries groups""".split()
PAST_IRREGULAR = """said told went came saw got made took gave found knew thought became left felt brought began kept held wrote
stood heard let meant set met ran paid sat spoke lay led read grew lost fell sent built understood drew broke spent cut
rose drove bought wore chose""".split()
TOKEN = "[a-z][a-z'-]*"
PUNCTUATION = "[,.;:!?\\-—'\"()]"
LIST_PROMISE = r"(?i)\b(\d{1,3})\s+(things|ways|reasons|tips|facts|signs|times|people|photos|steps|rules|secrets|lessons)\b"
MID_CAPITAL = r"(?<!^)(?<![.!?]\s)\b([A-Z][a-z]{2,})\b"
TRACKING = "[?&](utm_[a-z]+|ref|source|fbclid|gclid)=[^&]*"


def norm_exact(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def norm_ws_lower(t: Column) -> Column:
    return F.lower(norm_exact(t))


def norm_loose(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9\s]", " "), r"\d+", "#"), r"\s+", " "))


def norm_headline(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalise_url(u: Column) -> Column:
    """A link without the differences that lead to the same place; null gives the empty string."""
    steps = [("^https?://", ""), (r"^www\.", ""), (TRACKING, ""), ("#.*$", ""), ("[/?&]+$", "")]
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, F.lower(F.trim(F.coalesce(u, F.lit("")))))


def clean_number(c: Column) -> Column:
    """A number out of a vendor's cell: thousands separators, currency and percent signs dropped, else null."""
    return F.regexp_replace(c, "[,$£€%\\s]", "").try_cast("double")


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0))


def content_tokens(t: Column) -> Column:
    """Tokens without function words; all of them where nothing else is left."""
    toks = tokens(t)
    kept = F.filter(toks, lambda w: ~w.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(toks)


def share_of(toks: Column, words: list[str]) -> Column:
    return count_of(toks, words) / F.greatest(F.size(toks), F.lit(1))


def count_of(toks: Column, words: list[str]) -> Column:
    return F.size(F.filter(toks, lambda w: w.isin(words)))


def quote_count(t: Column) -> Column:
    """Straight quotes, double and single."""
    return F.regexp_count(t, F.lit("[\"']"))


def surface(t: Column) -> dict[str, Column]:
    """Features that need no lexicon: counts, ratios and densities of the raw text."""
    toks, chars = tokens(t), F.length(t)
    n, c = F.greatest(F.size(toks), F.lit(1)), F.greatest(chars, F.lit(1))
    sentences = F.size(F.filter(F.split(t, "[.!?]+"), lambda s: F.length(F.trim(s)) > 0))
    digits = F.regexp_count(t, F.lit("[0-9]"))
    return {
        "n_words": F.size(toks), "n_chars": chars,
        "avg_word_len": F.aggregate(toks, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)) / n,
        "long_word_frac": F.size(F.filter(toks, lambda w: F.length(w) >= 8)) / n,
        "n_sentences": F.greatest(sentences, F.lit(1)), "avg_sent_len": F.size(toks) / F.greatest(sentences, F.lit(1)),
        "type_token_ratio": F.size(F.array_distinct(toks)) / n, "stopword_frac": share_of(toks, STOPWORDS),
        "exclaim_count": F.regexp_count(t, F.lit("!")), "question_count": F.regexp_count(t, F.lit("[?]")),
        "caps_ratio": F.regexp_count(t, F.lit("[A-Z]")) / c, "digit_ratio": digits / c, "has_number": (digits > 0).cast("double"),
        "punct_density": F.regexp_count(t, F.lit(PUNCTUATION)) / c, "quote_count": quote_count(t),
    }


def curiosity(t: Column) -> dict[str, Column]:
    """Question words, open referents and list promises; person, negation and consensus shares."""
    toks = tokens(t)
    wh = count_of(toks, WH_WORDS)
    lead = F.coalesce(F.try_element_at(toks, F.lit(1)).isin(DEMONSTRATIVES), F.lit(False)).cast("double")
    promise = t.rlike(LIST_PROMISE).cast("double")
    dots = F.regexp_count(t, F.lit(r"\.\.\.|…")).cast("double")
    neg = count_of(toks, NEGATIONS)
    return {
        "wh_frac": share_of(toks, WH_WORDS), "leading_demonstrative": lead, "num_list_promise": promise, "ellipsis_count": dots,
        "curiosity_score": 0.4 * F.least(wh, F.lit(2)) / 2.0 + 0.3 * lead + 0.2 * promise + 0.1 * F.least(dots, F.lit(1.0)),
        "second_person_frac": share_of(toks, SECOND_PERSON), "first_person_frac": share_of(toks, FIRST_PERSON),
        "negation_frac": share_of(toks, NEGATIONS), "has_negation": (neg > 0).cast("double"), "consensus_frac": share_of(toks, CONSENSUS),
    }


def narrative(t: Column) -> dict[str, Column]:
    """Who acts and when: single persons and past verbs on one side, groups of people on the other."""
    toks = tokens(t)
    n = F.greatest(F.size(toks), F.lit(1))
    third, many = count_of(toks, THIRD_SINGULAR), count_of(toks, COLLECTIVE)
    past = F.size(F.filter(toks, lambda w: w.isin(PAST_IRREGULAR) | w.rlike("^[a-z]+ed$")))
    caps = F.regexp_count(t, F.lit(MID_CAPITAL))
    two = lambda c: F.least(c, F.lit(2)) / 2.0
    agent = (third > 0).cast("double")
    return {
        "third_singular_frac": third / n, "collective_frac": many / n, "individual_minus_collective": (third - many) / n,
        "has_individual_agent": agent, "past_tense_frac": past / n,
        "narrative_score": 0.5 * two(third) + 0.3 * two(past) + 0.2 * (caps > 0).cast("double"),
        "midcap_count": caps.cast("double"), "specific_referent_score": agent + two(caps) - two(many),
    }


def guardrails(t: Column) -> Column:
    """array<struct(kind, severity)> of surface risks that a ranker does not see."""
    f = surface(t)
    density = 100.0 * f["exclaim_count"] / F.greatest(f["n_chars"], F.lit(1))
    risk = lambda ok, kind, s: F.when(ok, F.struct(F.lit(kind).alias("kind"), F.least(F.lit(1.0), s).alias("severity")))
    return F.array_compact(F.array(
        risk((f["caps_ratio"] > 0.3) & (f["n_words"] >= 3), "shouting", (f["caps_ratio"] - 0.3) / 0.7),
        risk((f["exclaim_count"] >= 2) & (density > 1.5), "exclamation", density / 6.0),
        risk((f["punct_density"] > 0.18) & (f["n_words"] >= 3), "punctuation", (f["punct_density"] - 0.18) / 0.2),
    ))


def max_severity(risks: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(risks, lambda r: r["severity"])), F.lit(0.0))
