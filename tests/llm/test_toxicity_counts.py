from pathlight.llm import toxicity


def test_lexicon_does_not_depend_on_partitions(spark):
    # two texts a slice: a word of all toxic texts that every other good text holds too
    data = [("river", 0), ("stone", 0)] * 40 + [("river scum", 1), ("stone", 0)] * 8

    def learnt(slices):
        return toxicity.learn_lexicon(spark.createDataFrame(spark.sparkContext.parallelize(data, slices), "text string, toxic int"))

    one, many = learnt(1), learnt(48)
    for p in (0, *toxicity.BEGINNINGS):
        assert one.keys[p].tolist() == many.keys[p].tolist() and one.weights[p].tolist() == many.weights[p].tolist()
    assert len(many.keys[0]) == 1
