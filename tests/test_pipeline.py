"""The whole chain from items to the base, with and without hot keys."""

from fairtender.checks import standin as st
from fairtender.plans.contracts import price_sample, regression_base
from fairtender.session import stage


def test_base_with_hot_keys(spark, sf):
    items = stage(st.selected_items(spark, sf))
    sources = [(items, st.answers(spark, sf)), (items.filter("year_suscripcion = 1999"), st.answers(spark, sf, 2))]
    catalogue = stage(st.catalogue(spark, sf))
    plain = regression_base(sources, catalogue, st.BASE_YEARS)
    split = stage(regression_base(sources, catalogue, st.BASE_YEARS, hot_rows=5))

    def rows(df):
        return sorted(map(repr, df.select(*sorted(df.columns)).collect()))

    assert rows(plain) == rows(split) != []
    assert rows(price_sample(stage(plain))) == rows(price_sample(split, hot_rows=3))
