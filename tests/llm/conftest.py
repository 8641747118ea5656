from __future__ import annotations

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("needs the driver's tables")
    return SF_DIR
