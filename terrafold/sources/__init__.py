"""Libraries of features and what they are read from."""
