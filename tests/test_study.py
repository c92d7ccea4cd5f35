from passageway.operators.encode import term_stats
from passageway.plans import study

SF = "/root/testdata/sf0.001"


def test_both_forms_of_the_questions_in_one_pass(spark):
    units = study.document_units(spark, SF)
    stats = term_stats(units, "id")
    both = study.vector_both(spark, SF, units, 5, study.INSTRUCTION)
    for got, prefix in zip(both, (None, study.INSTRUCTION)):
        expected = study.vector(spark, SF, units, 5, stats, prefix)
        assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))
