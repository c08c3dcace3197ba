"""Training-data operators: ten corpus operators, their queries, nothing else imports them."""
