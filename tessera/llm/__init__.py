"""Training-data operators: one module per operator, plus the shared helpers in ``blocks``."""
