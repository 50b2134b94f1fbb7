from __future__ import annotations

from skein.llm.places import Places


def test_all_entries_within_the_distance_are_given_beside_an_exact_one():
    places = Places([(1, ["Chanoduri"]), (2, ["Chanodura"]), (3, ["Kvimashveli"])])
    assert places.all_near("chanoduri") == [(0, 1), (1, 2)]
    assert places.find("chanoduri") == 1 and places.find("chanodure") == -1 and places.all_near("") == []
