from sitelens.operators import dims


def test_list_sizes():
    assert len(dims.STOP_WORDS) == 103
    assert len(set(dims.STOP_WORDS)) == 103
    sizes = {t: len(v) for t, v in dims.INDICATORS.items()}
    assert sum(sizes.values()) == 163
    assert sizes == {
        "Ecommerce": 17, "SaaS": 17, "Blog": 11, "Portfolio": 10, "Service": 14, "Agency": 10,
        "LocalBusiness": 10, "Restaurant": 11, "Education": 13, "Healthcare": 13, "RealEstate": 14,
        "Technology": 13, "NonProfit": 10,
    }
    assert (len(dims.POSITIVE_WORDS), len(dims.NEGATIVE_WORDS), len(dims.POWER_WORDS), len(dims.EMOTIONAL_TRIGGERS)) == (54, 34, 52, 32)
    assert len(dims.SCHEMA_TRENDS) == 12
    assert sum(len(t[3]) for t in dims.SCHEMA_TRENDS) == 35
    assert len(dims.BUSINESS_TYPES) == 14


def test_dimension_frames(spark):
    assert dims.indicators(spark).count() == 163
    assert dims.lexicon(spark).count() == 54 + 34 + 52 + 32
    assert dims.schema_trends(spark).count() == 35
