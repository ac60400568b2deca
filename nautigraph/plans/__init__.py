"""nautigraph.plans"""
