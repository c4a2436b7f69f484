"""Which joins the optimizer may not turn into a broadcast: those of rows that were unfolded from few."""

import pytest

import __spark_entry__ as entry

#: Queries with the least number of such joins.
UNFOLDED = {"character_oracle": 2, "conservative_top1": 2, "decode_word_topk": 2, "frozen_pool_rerank": 2, "hybrid_rerank": 2, "interactive_query_whole": 4, "labelled_rejection_sweep": 4, "layered_query": 4, "noisy_lattice": 3, "rejection_sweep": 2, "sentence_kbest_bigram_noisy": 3, "sentence_lanes": 3, "swap_recovery_sentences": 5, "paired_rank_stats": 4, "public_context_rerank": 2, "sentence_kbest_unigram": 3, "decode_checksum": 2, "protocol_decode_whole": 2}


@pytest.mark.parametrize("name", UNFOLDED)
def test_unfolded_rows_are_not_broadcast(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= UNFOLDED[name]


#: Queries over codes read as two words, with how many texts of a cut they shuffle at most.
CUTS = {"continuous_composition": 10, "interactive_query": 20}


@pytest.mark.parametrize("name", CUTS)
def test_only_the_best_of_a_cut_are_shuffled(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(pairs#" in plan and f", 1, {CUTS[name]}" in plan


#: Queries whose other tables grow too, with the least number of joins in which nothing may be broadcast.
GROWING = {"conservative_top1": 3, "frozen_pool_rerank": 3, "labelled_rejection_sweep": 4, "rejection_sweep": 4, "public_context_rerank": 5}


@pytest.mark.parametrize("name", GROWING)
def test_growing_tables_are_not_broadcast(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if " Join " in f" {line.lstrip(' :+-')}"]
    assert len(joins) >= GROWING[name] and all("strategy=merge" in line for line in joins)


@pytest.mark.parametrize("name", CUTS)
def test_readings_of_a_cut_are_shuffled_in_one_row(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(collect_list(few#" in plan


def test_words_of_fixed_readings_are_not_broadcast(spark, small):
    plan = entry.queries()["protocol_decode_whole"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 4


def test_parts_of_typed_codes_are_made_once_and_sifted(spark, small):
    plan = entry.queries()["protocol_decode_whole"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("shiftrightunsigned") >= 2
