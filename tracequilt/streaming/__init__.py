"""The same operators over ``readStream``, plus the stateful ones."""
