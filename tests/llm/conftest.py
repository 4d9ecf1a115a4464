from __future__ import annotations

import pytest


@pytest.fixture(autouse=True)
def nothing_kept(request):
    """A test that asks whether something stays cached is not to see what a fixture of another caches."""
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()
