from pyspark.sql import functions as F

from annolytics.functions import privacy, text


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first().r


def test_normalisation_golden(spark):
    assert one(spark, text.normalize_repeated_characters, "muitooo") == "muito"
    assert one(spark, text.clean_tweet_text, "RT @exemplo:   ótimo   produto  ") == "ótimo produto"
    assert one(spark, text.normalize_tweet_text, "RT @joão: veja https://x.co/a #Legal @ana 🚀🚀  siiim") == "veja [URL] Legal [MENCAO] [EMOJI] sim"
    assert one(spark, lambda c: text.normalize_hashtags(c, keep_word=False), "#a b") == "[HASHTAG] b"
    assert not one(spark, text.is_minimum_length_content, "bom")
    assert one(spark, text.repeated_word_ratio, "promo promo promo compre agora") == 0.6
    assert one(spark, text.repeated_word_ratio, "") == 0.0
    assert one(spark, text.normalize_tweet_text, None) is None


def test_tokens_slang_negation(spark):
    assert one(spark, text.tokenize_text, "Olá, [URL] guarda-chuva 123!") == ["Olá", ",", "[URL]", "guarda-chuva", "!"]
    got = one(spark, lambda c: text.expand_contractions(F.split(c, " ")), "vc eh gente mto")
    assert got == ["você", "é", "gente", "muito"]
    assert one(spark, text.tokenize_and_normalize, "não gostei nada. amei") == ["não", "gostei_NEG", "nada_NEG", ".", "amei"]


def test_language_and_keys(spark):
    assert one(spark, text.is_probable_portuguese_text, "o produto é muito bom")
    assert not one(spark, text.is_probable_portuguese_text, "this thing here works")
    assert one(spark, text.duplicate_key, "  ÓTIMO!! ") == "ótimo"
    assert one(spark, text.parse_yes_no, "<think>no</think> Sim, claro") == 1
    assert one(spark, lambda c: text.truncate_text(c, 6), "abcdefghij") == "abc..."
    assert one(spark, lambda c: text.row_id(F.lit(12)), "") == "t0000012"


def test_masking_golden(spark):
    raw = "@fulano veja https://x.com/a1 ou a@b.com cpf 529.982.247-25 tel (11) 91234-5678 ótimo"
    assert one(spark, privacy.mask_personal_data, raw) == "@usuario veja <url> ou <email> cpf <cpf> tel <telefone> ótimo"
    assert one(spark, privacy.validate_cpf, "529.982.247-25")
    assert not one(spark, privacy.validate_cpf, "111.111.111-11")
    assert not one(spark, privacy.validate_cpf, "529.982.247-24")


def test_masked_columns_and_counts(spark):
    df = spark.createDataFrame([("a@b.com", "a@b.com", "x@y.org @ana")], "text string, other string, example_1 string")
    got = privacy.mask_text_columns(df).first()
    assert (got.text, got.other, got.example_1) == ("<email>", "a@b.com", "<email> @usuario")
    counts = privacy.count_personal_data(df, "example_1").first()
    assert (counts.mencao, counts.email, counts.url, counts.total) == (1, 1, 0, 1)


def test_hmac(spark):
    import hashlib
    import hmac

    want = hmac.new(b"secret", "ana".encode(), hashlib.sha256).hexdigest()[:20]
    assert one(spark, lambda c: privacy.pseudonymize_value(c, b"secret"), "ana") == want
