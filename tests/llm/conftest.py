import os

import pytest

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="session")
def vocabulary():
    if not os.path.exists(VOCABULARY):
        pytest.skip("the public vocabulary is not here")
    return VOCABULARY
