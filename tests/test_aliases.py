"""The filter before alias detection lets every alias pass."""

from folioloom.operators import agenda as A


def test_every_alias_has_one_of_the_shortest():
    words = [w for role in A.ALIASES.values() for w in role]
    assert all(any(s in w for s in A.SHORTEST) for w in words) and set(A.SHORTEST) < set(words)
