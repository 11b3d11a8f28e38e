import pytest

from trustloom.sources import providers


def test_only_registered_classes_are_made():
    with pytest.raises(ValueError):
        providers.restored({"module": "subprocess", "class_name": "Popen", "args": "true"})

    class Quiet:
        def __init__(self, temperature):
            self.temperature = temperature

    held = {"module": Quiet.__module__, "class_name": "Quiet", "temperature": 0.1}
    with pytest.raises(ValueError):
        providers.restored(held)
    providers.register(Quiet)
    assert providers.restored(held).temperature == 0.1
