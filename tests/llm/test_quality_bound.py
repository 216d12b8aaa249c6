from geoloom.llm import quality_model


def test_a_very_long_text_does_not_end_the_sample(spark):
    """Whatever its place in md5 order, a text above the bound leaves the others in."""
    rows = [(i, ("good words here " if i % 2 else "BAD ### !! ") * 20) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for long in range(0, 40, 13):
        docs = spark.createDataFrame([(i, t * 40 if i == long else t) for i, t in rows], "doc_id long, text string")
        assert isinstance(quality_model.train(docs, labels, folds=1, held=1, passages_held=37), quality_model.AttentionModel)
