"""Training-data operators: one module per operator, all DataFrame in, DataFrame out."""
