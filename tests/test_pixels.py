from framelake.functions import pixels as X


def test_hamming_pairs_with_repeated_texts(spark):
    texts = {1: "0" * 24, 2: "0" * 24, 3: "0" * 23 + "1", 4: "1" * 24, 5: "0" * 24, 6: "0" * 23 + "1", 7: None, 8: None}
    df = spark.createDataFrame(list(texts.items()), "id long, bits string")
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    want = sorted((a, b, far(texts[a], texts[b])) for a in texts for b in texts if a < b and texts[a] and texts[b] and far(texts[a], texts[b]) < 3)
    assert sorted(tuple(r) for r in X.hamming_pairs(df, "id", "bits", 24, 3).collect()) == want
    assert dict(tuple(r) for r in X.hamming_classes(df.where("bits is not null"), "id", "bits").collect()) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 3}
