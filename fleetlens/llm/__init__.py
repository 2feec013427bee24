"""Training-data operators: one module per operator, registered queries in ``queries``."""
