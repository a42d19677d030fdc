"""What is made of small summaries on the driver: findings, cards, digests."""
