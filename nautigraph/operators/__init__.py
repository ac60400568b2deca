"""nautigraph.operators"""
