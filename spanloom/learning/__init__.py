"""Trainers: stochastic gradient descent on partitions, averaged each round."""
