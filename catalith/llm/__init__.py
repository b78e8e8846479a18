"""Training-data operators: each takes and returns DataFrames. Nothing else imports them."""
