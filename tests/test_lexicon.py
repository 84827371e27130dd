from concord.functions import lexicon as L


def test_parse_lexicon_sizes():
    sizes = {k: len(v.entries) for k, v in L.PARSE_LEXICONS.items()}
    assert sizes == {"en_RC_PP": 58, "en_RC_PP_gen": 58, "en_FVN_02": 229, "en_VN_98": 172}


def test_no_word_in_two_categories():
    for lex in L.PARSE_LEXICONS.values():
        assert len(lex.entries) == len(set(lex.entries))


def test_shape_table():
    assert len(L.SHAPES) == 33
    assert L.SHAPE_TOTAL == 94_507_008
    for s in L.SHAPES:
        assert len(s.template) <= L.MAX_SENTENCE_WORDS
        assert s.template[s.verb_pos] == "V"
        assert s.hi - s.lo == s.weight


def test_inflection_table():
    # 20 verbs x 2 numbers
    for g in L.SAMPLING_GRAMMARS.values():
        for v in g.verbs:
            sg, pl = L.inflect(v, "sg"), L.inflect(v, "pl")
            assert sg.endswith("s") and not pl.endswith("s")
            assert sg[:-1] == pl or sg[:-2] == pl   # -es / -s
    assert L.inflect("liked", "sg") == "likes" and L.inflect("liked", "pl") == "like"
    assert L.inflect("helped", "sg") == "helps" and L.inflect("helped", "pl") == "help"
    assert L.inflect("eclipsed", "sg") == "eclipses" and L.inflect("eclipsed", "pl") == "eclipse"


def test_plural_lists():
    for sg, pl in ((L.FVN_NOUNS_SG, L.FVN_NOUNS_PL), (L.VN_NOUNS_SG, L.VN_NOUNS_PL)):
        assert len(sg) == len(pl) == len(set(pl)) and all(p.endswith("s") for p in pl)
    both = dict(zip(L.FVN_NOUNS_SG, L.FVN_NOUNS_PL))
    assert [both[w] for w in ["city", "speech", "switch", "stairway", "inn-keeper", "photo"]] == \
        ["cities", "speeches", "switches", "stairways", "inn-keepers", "photos"]


def test_shape_bound_follows_the_word_cap():
    import pytest
    assert max(len(s.subj_mods + s.obj_mods) for s in L.build_shapes(11)) == 2 and len(L.build_shapes(5)) == 1
    with pytest.raises(ValueError):
        L.build_shapes(17)


def test_quotas():
    assert len(L.BALANCED_QUOTAS) == 42
    assert sum(L.BALANCED_QUOTAS.values()) == 10_368
