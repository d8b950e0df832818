from pyspark.sql import functions as F

from trialworks.functions import text as X

# Features of sixteen texts; those that are not named are 0.
CASES = [
    ("Save 20% today. Limited time only!", "exclaim_count=1 caps_ratio=0.058824 digit_ratio=0.058824 has_number=1 n_words=5 n_chars=34 avg_word_len=4.8 n_sentences=2 type_token_ratio=1 punct_density=0.058824"),
    ("The quarterly report is now available for download.", "caps_ratio=0.019608 n_words=8 n_chars=51 avg_word_len=5.375 long_word_frac=0.375 n_sentences=1 type_token_ratio=1 stopword_frac=0.5 punct_density=0.019608"),
    ("Join over one million happy customers worldwide", "caps_ratio=0.021277 n_words=7 n_chars=47 avg_word_len=5.857143 long_word_frac=0.285714 n_sentences=1 type_token_ratio=1"),
    ("This Is What Happens When You Ignore 7 Warning Signs", "caps_ratio=0.173077 digit_ratio=0.019231 has_number=1 n_words=9 n_chars=52 avg_word_len=4.666667 n_sentences=1 type_token_ratio=1 stopword_frac=0.333333"),
    ("A Fan Called Her Ugly And Fat. Her Response Is Top Notch.", "caps_ratio=0.210526 n_words=12 n_chars=57 avg_word_len=3.666667 long_word_frac=0.083333 n_sentences=2 type_token_ratio=0.916667 stopword_frac=0.416667 punct_density=0.035088"),
    ("", "n_sentences=1"),
    ("the and of to a", "n_words=5 n_chars=15 avg_word_len=2.2 n_sentences=1 type_token_ratio=1 stopword_frac=1"),
    ("AAAAA!!!", "exclaim_count=3 caps_ratio=0.625 n_words=1 n_chars=8 avg_word_len=5 n_sentences=1 type_token_ratio=1 punct_density=0.375"),
    ("SHOUTING IN ALL CAPS RIGHT NOW", "caps_ratio=0.833333 n_words=6 n_chars=30 avg_word_len=4.166667 long_word_frac=0.166667 n_sentences=1 type_token_ratio=1 stopword_frac=0.333333"),
    ("42", "digit_ratio=1 has_number=1 n_chars=2 n_sentences=1"),
    ("Won't you? Can't we! Shouldn't they...", "exclaim_count=1 question_count=1 caps_ratio=0.078947 quote_count=3 n_words=6 n_chars=38 avg_word_len=4.666667 long_word_frac=0.166667 n_sentences=3 type_token_ratio=1 stopword_frac=0.5 punct_density=0.210526"),
    ("hello", "n_words=1 n_chars=5 avg_word_len=5 n_sentences=1 type_token_ratio=1"),
    ("supercalifragilisticexpialidocious", "n_words=1 n_chars=34 avg_word_len=34 long_word_frac=1 n_sentences=1 type_token_ratio=1"),
    ("Multi. Sentence. Copy. Here.", "caps_ratio=0.142857 n_words=4 n_chars=28 avg_word_len=5.25 long_word_frac=0.25 n_sentences=4 type_token_ratio=1 punct_density=0.142857"),
    ("  leading and trailing whitespace  ", "n_words=4 n_chars=35 avg_word_len=7 long_word_frac=0.5 n_sentences=1 type_token_ratio=1 stopword_frac=0.25"),
    ("Café naïve résumé", "caps_ratio=0.058824 n_words=5 n_chars=17 avg_word_len=2.2 n_sentences=1 type_token_ratio=1"),
]


def test_features_of_sixteen_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, text string")
    got = {r.id: r.asDict() for r in docs.select("id", *[c.cast("double").alias(k) for k, c in X.surface(F.col("text")).items()]).collect()}
    for i, (text, values) in enumerate(CASES):
        want = {k: float(v) for k, v in (x.split("=") for x in values.split())}
        want["avg_sent_len"] = want.get("n_words", 0) / want["n_sentences"]
        for name, value in got[i].items():
            if name != "id":
                assert abs(value - want.get(name, 0)) < 1e-4, (text, name, value)
